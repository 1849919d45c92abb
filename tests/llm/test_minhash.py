import random
import re

from litomics.llm import components, minhash

from .cases import docs, sample


def plain(rows, n, similarity=80):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(sets[d]), top(d), top(d) == d) for d in ids}


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_against_plain(spark):
    texts = [*sample("documents"), *near_copies(40, 60, 8, 1), *near_copies(40, 120, 12, 2), "One two", "one TWO", "one", "One"]
    random.Random(4).shuffle(texts)
    frame = docs(spark, texts)
    for n in (2, 5):
        want = plain([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").distinct().collect()], n)
        rows = minhash.classes(frame, words=n).collect()
        assert len(rows) == frame.count()
        for r in rows:
            assert tuple(r)[1:] == want[r["doc_id"]]
        assert sum(not x[2] for x in want.values()) > 20


def test_nulls_and_empty(spark):
    frame = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (0, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r)[2:] for r in minhash.classes(frame, words=2).collect()))) == sorted(map(str, [(None, True), (0, False), (0, True), (None, True)]))
    assert minhash.classes(frame.limit(0)).collect() == []
    assert minhash.keep_one(frame.where("doc_id is not null")).collect()[0]["doc_id"] == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (32, 31), (40, 40)], "a long, b long")
    assert dict(components.roots(links).collect()) == {**{i: 0 for i in range(1, 21)}, 31: 30, 32: 30}
