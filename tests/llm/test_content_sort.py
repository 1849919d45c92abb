import hashlib
from collections import defaultdict

import pytest

from litomics.llm import content_sort

from .cases import docs, sample


def plain(rows):
    """(doc_id, keep_id, group_size, sha256) of each row, and the texts with the doc_id that stays."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(r["doc_id"], keep[r["text"] or ""], len(groups[r["text"] or ""]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows], keep


def check(frame):
    given = frame.collect()
    found = content_sort.dedup(frame).collect()
    want, keep = plain(given)
    assert sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found))) == sorted(map(str, want))
    kept = sorted(str((r["text_sha256"], r["doc_id"])) for r in found if r["kept"])
    assert kept == sorted(str((hashlib.sha256(t.encode()).hexdigest(), i)) for t, i in keep.items())


@pytest.mark.parametrize("held", [1, 3_000, 32_000_000])
@pytest.mark.parametrize("prefix", [1, 64])
def test_against_plain(spark, monkeypatch, held, prefix):
    monkeypatch.setattr(content_sort, "HELD_BYTES", held)
    monkeypatch.setattr(content_sort, "PREFIX", prefix)
    check(docs(spark, sample("documents")))


def test_shared_beginnings_and_large_groups(spark):
    long = "the same beginning of many documents " * 40
    texts = [long + str(i % 150) for i in range(400)] + ["hot"] * 500 + [long, long[:-1], "hot ", "Hot", "ho"]
    check(docs(spark, texts))


def test_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "a"), (None, "b"), (3, "b"), (3, "b"), (2, "b"), (None, None), (5, ""), (5, ""), (7, "only"), (None, "lone"), (-1, "neg"), (-2, "neg")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_hot_and_other_groups_meet_the_same_rule(spark, monkeypatch):
    monkeypatch.setattr(content_sort, "HOT", 1 / 20)
    check(docs(spark, ["hot"] * 100 + [f"t{i % 60}" for i in range(200)]))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, hash long, n long, keep_id string, row string")
    assert content_sort.dedup(empty).collect() == []
    clash = spark.createDataFrame([(1, "x", 5, "k", "r", 2), (2, "x", 6, "k", "r", 3)], "doc_id long, text string, hash long, keep_id string, row string, group_size int")
    check(clash)


def test_neighbours_are_compared_whole(spark, monkeypatch):
    """Texts of one beginning and one hash stay apart."""
    monkeypatch.setattr(content_sort.F, "xxhash64", lambda *c: content_sort.F.lit(1).cast("long") if c == ("content",) else real(*c))
    check(docs(spark, ["same start " * 20 + str(i % 30) for i in range(90)], extra=False))


real = content_sort.F.xxhash64
