import re

from litomics.llm import templates

from .cases import docs

ITEMS = [
    "A train leaves Boston at 60 km per hour and travels 3 hours before it stops near Albany for a rest of 20 minutes.",
    "If Anna has 12 apples and gives 5 of them to Peter then how many apples does Anna still keep in her basket?",
    "short item here",
    None,
    "",
]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def found(spark, texts, items=ITEMS):
    rows = templates.contained_items(docs(spark, texts), bench(spark, items)).collect()
    return {(r["doc_id"], r["item_id"]): r["n_changed"] for r in rows}


def test_verbatim_and_reparameterised(spark):
    changed = ITEMS[1].replace("12", "31").replace("5", "7").replace("Anna", "Clara").replace("Peter", "Omar")
    torn = ITEMS[1].replace("12", "31").replace("Anna still", "Olga still").replace("Anna has", "Clara has")
    texts = [
        "Intro text. " + ITEMS[0] + " More text follows.",
        "before " + changed + " after",
        "Nothing of the kind is in this text, which only mentions Boston and 60 km.",
        "words words " + " ".join(ITEMS[0].split()[:9]) + " words",
        "this is a short item here indeed",
    ]
    got = found(spark, [*texts, torn])
    assert got.keys() == {(0, 0), (1, 1), (4, 2)}, got
    assert got[0, 0] == 0 and got[1, 1] == 4


def test_table_against_plain(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in templates.contained_items(d, b).collect()}
    squeeze = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    items = {r["item_id"]: squeeze(r["text"]) for r in b.collect()}
    texts = {r["doc_id"]: squeeze(r["text"]) for r in d.collect()}
    want = {(i, k) for i, t in texts.items() for k, x in items.items() if x in t}
    assert want <= got
    assert len(got) <= 1.2 * len(want) + 2


def test_empty_tables(spark):
    assert templates.contained_items(docs(spark, [], extra=False), bench(spark)).collect() == []
    frame = docs(spark, ["a b c " * 9])
    assert templates.contained_items(frame, bench(spark, [])).collect() == []
    assert templates.keep_clean(frame, bench(spark)).count() == frame.count()


def test_openers_short_items_and_numbers(spark):
    items = [
        "Tom has 5 apples. Tom buys 3 more. Tom eats 2. How many apples does Tom have?",
        "Who wrote the great novel of Spain?",
        "12 7 9 30 45 81 3 66 52 10",
        "4 times 5 is 20",
    ]
    texts = [
        "Before. " + items[0].replace("Tom", "Anna").replace("5", "8").replace("3", "6") + " After.",
        "A heading line\nWho wrote the great novel of Spain? Nobody knows.",
        "the numbers " + items[2] + " stand here",
        "the numbers 12 7 9 30 45 81 3 66 and no more",
        "we say 4 times 5 is 20 here",
        "Tom has no pears. Anna buys one. Who wrote that?",
    ]
    got = found(spark, texts, items)
    assert got.keys() == {(0, 0), (1, 1), (2, 2), (4, 3)}, got
    assert got[0, 0] == 3 and got[2, 2] == 0


def test_scattered_windows_do_not_add_up(spark):
    words = ITEMS[0].split()
    far = " ".join(f"w{i}" for i in range(90))
    texts = [f" {far} ".join(" ".join(words[a : a + 9]) for a in range(0, 18, 3)), far + " " + " ".join([*words[:9], "indeed", *words[9:]])]
    assert found(spark, texts).keys() == {(1, 0)}


def test_a_large_benchmark_is_shuffled_alike(spark, monkeypatch):
    texts = ["Intro text. " + ITEMS[0], "before " + ITEMS[1].replace("12", "31") + " after", "a short item here"]
    near = found(spark, texts)
    monkeypatch.setattr(templates, "MOST_WINDOWS", 3)
    assert found(spark, texts) == near and len(near) == 3


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(templates, "MEMO_WORDS", 5)
    few, many = templates.Templates(), templates.Templates()
    lines = [[w.encode() for w in f"Word{i} costs {i} km or Peter{i % 3} ends.".split()] for i in range(40)]
    whole = many(lines)
    for i, line in enumerate(lines):
        assert len(few.canon) <= 5 + 7
        for x, y in zip(few([line])[:3], whole[:3], strict=True):
            assert (x == y[7 * i : 7 * i + 7]).all()
