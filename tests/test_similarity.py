import difflib
import random

import pytest

from litomics.operators import disease, similarity

ALPHABETS = ["ab", "abc de", "abcdefghijklmnop é\U0001f600"]


def plain(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def pairs_of(seed, n, alphabet, longest=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(longest)))
    for _ in range(n):
        a = word()
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(alphabet)
        yield a, rng.choice([word(), "".join(b), a[::-1]])


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("cells", [50, 2_000_000])
def test_ratios_equal_the_plain_matcher(monkeypatch, alphabet, cells):
    monkeypatch.setattr(similarity, "CELLS", cells)
    pairs = [*pairs_of(len(alphabet), 400, alphabet), ("", ""), ("", "a"), ("a", ""), ("a" * 300, "a" * 250)]
    got = similarity.ratios(*map(list, zip(*pairs, strict=True)))
    assert all(abs(g - plain(a, b)) < 1e-12 for g, (a, b) in zip(got, pairs, strict=True))
    assert len(similarity.ratios([], [])) == 0


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_bounds_lose_no_pair(spark, threshold):
    pairs = list({p for alphabet in ALPHABETS for p in pairs_of(7, 300, alphabet)})
    frame = spark.createDataFrame(pairs, "a string, b string")
    kept = {(r["a"], r["b"]): r["ratio"] for r in similarity.with_ratio(similarity.candidates(frame, "a", "b", threshold), "a", "b").collect()}
    want = {p: plain(*p) for p in pairs}
    assert {p for p, r in want.items() if r >= threshold} <= kept.keys()
    assert all(abs(want[p] - r) < 1e-12 for p, r in kept.items())
    bounds = frame.select("a", "b", similarity.length_bound(frame.a, frame.b).alias("x"), similarity.letter_bound(frame.a, frame.b).alias("y")).collect()
    assert all(r["x"] + 1e-12 >= r["y"] >= want[r["a"], r["b"]] - 1e-12 for r in bounds)


def test_few_pairs_reach_the_blocks(spark, capsys):
    """Names of diseases that share a token: most cannot reach the threshold by their letters alone."""
    rng = random.Random(3)
    heads, kinds = ["familial", "juvenile", "acute", "chronic", "severe", "early onset"], ["anaemia", "myopathy", "dystrophy", "syndrome"]
    names = sorted({f"{rng.choice(heads)} {''.join(rng.choices('aeioulmnrst', k=rng.randrange(3, 12)))} {k} type {rng.randrange(30)}" for k in kinds for _ in range(60)})
    pairs = spark.createDataFrame([(a, b) for a in names[:80] for b in names if a.split()[-3] == b.split()[-3]], "a string, b string")
    n, left = pairs.count(), similarity.candidates(pairs, "a", "b", 0.85).count()
    with capsys.disabled():
        print(f"\n{left} of {n} pairs reach the exact step")
    assert left < 0.5 * n


def test_fuzzy_hits_against_a_plain_version(spark):
    rng = random.Random(5)
    words = ["anaemia", "familial", "syndrome", "muscular", "dystrophy", "fever", "hearing", "retinal", "of", "type"]
    names = [(rng.choice(["monogenic", "multifactorial"]), " ".join(rng.sample(words, rng.randrange(1, 5))) + rng.choice(["", " 1", "-2", "!"])) for _ in range(120)]
    terms = [" ".join(rng.sample(words, rng.randrange(1, 5))).replace("ae", rng.choice(["ae", "e"])) for _ in range(80)]
    got = {(r["term"], r["axis"]): (r["name"], round(r["ratio"], 9)) for r in disease.fuzzy_hits(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(names, "axis string, name string")).collect()}
    clean = lambda t: " ".join("".join(c if c.isalnum() or c in " -_" else " " for c in t.lower()).split())
    refs = {}
    for axis, name in names:
        refs.setdefault(axis, set()).add((clean(name), name))
    want = {}
    for term in set(terms):
        q = clean(term)
        tokens = [w for w in q.split(" ") if len(w) >= 5][:3]
        for axis, held in refs.items():
            count = {w: sum(w in n.split(" ") for n, _ in held) for w in tokens}
            known = [(count[w], k, w) for k, w in enumerate(tokens) if count[w]]
            if not known:
                continue
            rare = min(known)[2]
            best = min((-plain(q, n), n, name) for n, name in held if rare in n.split(" "))
            if -best[0] >= 0.85:
                want[term, axis] = (best[2], round(-best[0], 9))
    assert got == want and len(want) > 10


@pytest.mark.parametrize("threshold", [0, 0.5, 0.85])
def test_best_of_against_all_pairs(threshold):
    """Texts longer than the 64 letters of a part, of few letters so that many are equally similar, and empty ones."""
    for alphabet in ALPHABETS:
        rng = random.Random(8)
        first, second = (["".join(rng.choices(alphabet, k=rng.randrange(rng.choice([5, 30, 64, 66, 150])))) for _ in range(40)] for _ in range(2))
        best, ratio = similarity.best_of(first, second, threshold)
        for k, a in enumerate(first):
            every = [plain(a, b) for b in second]
            if max(every) < threshold:
                assert best[k] == -1
            else:
                assert best[k] == every.index(max(every)) and abs(ratio[k] - max(every)) < 1e-12


def test_few_pairs_of_a_common_token_are_judged(monkeypatch):
    """Many terms with one common token meet the same names; nearly all pairs are settled by their common letters."""
    judged = []
    exact = similarity.ratios
    monkeypatch.setattr(similarity, "ratios", lambda a, b: judged.append(len(a)) or exact(a, b))
    terms = [f"customer {k:09d} syndrome machinery" for k in range(50_000, 50_400)]
    names = [f"customer {k:09d} syndrom machinery" for k in range(200)]
    best, _ = similarity.best_of(terms, names, 0.8)
    assert (best >= 0).all() and sum(judged) < 0.1 * len(terms) * len(names)


def test_every_name_of_a_common_token_is_met(spark, monkeypatch):
    """Hundreds of names of one token, cut into tiles and parts: the most similar one counts wherever it stands, and the first of equally similar ones."""
    for size, value in (("TILE", 64), ("PART", 16), ("PAIRS", 600)):
        monkeypatch.setattr(disease, size, value)
    rng = random.Random(9)
    names = sorted({("monogenic", f"Dystrophy {''.join(rng.choices('abcd', k=6))}") for _ in range(400)} | {("multifactorial", f"dystrophy, {k}") for k in range(300)} | {("monogenic", "dystrophy: dddddd"), ("monogenic", "unasked token")})
    terms = ["dystrophy dddddd", "dystrophy 299", "dystrophy"] + [f"dystrophy {''.join(rng.choices('abcd', k=6))}" for _ in range(60)]
    rows = disease.fuzzy_hits(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(names, "axis string, name string"), 0.8).collect()
    got = {(r["term"], r["axis"]): (r["name"], round(r["ratio"], 9)) for r in rows}
    clean = lambda t: t.lower().replace(",", "").replace(":", "")
    want = {}
    for term in set(terms):
        for axis in ("monogenic", "multifactorial"):
            r, _, name = min((-plain(term, clean(name)), clean(name), name) for a, name in names if a == axis and "ystrophy" in name)
            if -r >= 0.8:
                want[term, axis] = (name, round(-r, 9))
    assert got == want and len(rows) == len(want) > 60
    assert got["dystrophy 299", "multifactorial"] == ("dystrophy, 299", 1.0)


@pytest.mark.parametrize("threshold", [0.5, 0.85])
def test_best_of_in_blocks_of_like_texts(threshold):
    """Numbered texts are bounded by what a block of them has in common; the result is that of all pairs, as it is where others among them leave one block."""
    rng = random.Random(4)
    second = [*sorted(f"type {k} fever" for k in range(900)), "", "type", " fever", "type fever"]
    first = [f"type {rng.randrange(3000)} {rng.choice(['fever', 'fevers', 'gout'])}" for _ in range(40)] + ["", "e", "type 5", "99 fever", "type \U0001f600 fever"]
    for names in (second, second[:900]):
        best, ratio = similarity.best_of(first, names, threshold)
        for k, a in enumerate(first):
            every = [plain(a, b) for b in names]
            if max(every) < threshold:
                assert best[k] == -1
            else:
                assert best[k] == every.index(max(every)) and abs(ratio[k] - max(every)) < 1e-12
    assert len(similarity._blocks(second[:900])[0]) > 1 and len(similarity._blocks(second)[0]) == 1


def test_best_of_where_nothing_is_near():
    best, ratio = similarity.best_of(["abc", "x"], ["defg", "hi"], 0.8)
    assert best.tolist() == [-1, -1] and all(r != r for r in ratio)
    assert [len(x) for x in (*similarity.best_of([], ["a"], 0.8), *similarity.best_of(["a"], [], 0.8))] == [0, 0, 1, 1]
