import hashlib
import random
import re

import pytest

from litomics.llm import substrings

from .cases import docs, sample


def plain(rows, window=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def shared_passages(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    passages = [[word() for _ in range(rng.randrange(10, 60))] for _ in range(12)]
    for _ in range(80):
        text = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += p[a : a + rng.randrange(5, 60)] if rng.random() < 0.6 else [word() for _ in range(rng.randrange(30))]
        yield rng.choice([" ", "\n", " \t"]).join(text)
    yield " ".join(["a b"] * 40)
    yield " ".join(["a b"] * 20)


def test_against_plain(spark):
    texts = [*sample("documents", 150), *shared_passages(1)]
    random.Random(2).shuffle(texts)
    frame = docs(spark, texts)
    want = plain([(r["doc_id"], r["text"]) for r in frame.collect()])
    rows = substrings.remove_repeats(frame).collect()
    assert len(rows) == frame.count()
    for r in rows:
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]
    assert sum(0 < x[1] < x[0] for x in want.values()) > 20


def test_automaton():
    parts = [([1, 2, 3, 4, 5], 7), ([2, 3, 4, 9], 3), ([3, 4, 5, 1], 5)]
    a = substrings.SuffixAutomaton(parts)
    assert a.first_of_windows([1, 2, 3, 4, 5, 1, 2], 3) == [7, 3, 5, 5, substrings.FAR]


def common_opening(seed):
    """Texts that all have one sentence, among different words, so its anchors have a region in each."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(40)}"
    for i in range(120):
        yield " ".join([*(word() for _ in range(12)), *"all of the rights are held by".split(), *(word() for _ in range(rng.randrange(4))), *(f"u{i}" for _ in range(8)), *"all of the rights".split()])


@pytest.mark.parametrize("shard, most", [(20, 2000), (50_000, 3), (20, 1)])
def test_small_shards_and_hot_anchors(spark, monkeypatch, shard, most):
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    monkeypatch.setattr(substrings, "MOST_REGIONS", most)
    texts = [*shared_passages(5), *common_opening(6), *list(common_opening(6))[:30]]
    random.Random(7).shuffle(texts)
    frame = docs(spark, texts)
    want = plain([(r["doc_id"], r["text"]) for r in frame.collect()])
    for r in substrings.remove_repeats(frame).collect():
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]


def test_runs_of_one_word_of_many_lengths_are_one_row(spark, monkeypatch):
    """Runs of 3,000 lengths meet as one window, not as 3,000 regions of one anchor."""
    monkeypatch.setattr(substrings, "MOST_REGIONS", 3)
    met = []
    real = substrings.first_documents
    monkeypatch.setattr(substrings, "first_documents", lambda regions, window: met.append(regions.groupBy("anchor").count().agg({"count": "max"}).first()[0] or 0) or real(regions, window))
    texts = [f"start{i} " + "- " * (13 + i) + f"end{i} " + " ".join(f"u{i}x{k}" for k in range(5)) for i in range(3000)]
    random.Random(3).shuffle(texts)
    frame = docs(spark, texts, extra=False)
    want = plain([(r["doc_id"], r["text"]) for r in frame.collect()])
    for r in substrings.remove_repeats(frame).collect():
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]
    assert max(met) <= 3


def test_null_ids_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(20))
    frame = spark.createDataFrame([(None, text), (5, text), (2, text + " end"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substrings.remove_repeats(frame).collect())
    assert got == [(-1, 0), (-1, 0), (2, 0), (5, 20)]
    assert substrings.remove_repeats(frame.limit(0)).collect() == []
