import numpy as np
import pytest

from litomics.llm import common


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 24])
def test_filtered_joins_are_exact(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    docs = spark.createDataFrame([(i % 400, f"t{i}") for i in range(500)] + [(None, "none")], "doc_id long, text string")
    for wanted in (range(0, 400, 7), [], range(400)):
        ids = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
        inside, outside = (sorted(map(str, f(docs, ids).collect())) for f in (common.within, common.without))
        assert inside == sorted(str(r) for r in docs.collect() if r["doc_id"] in set(wanted))
        assert outside == sorted(str(r) for r in docs.collect() if r["doc_id"] not in set(wanted))


def test_places_and_grams():
    starts = np.array([0, 3, 3, 4, 9])
    assert common.places(starts, 3).tolist() == [0, 4, 5, 6]
    h = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    g = common.gram_hashes(h, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 4
    assert common.places(np.array([0, 2]), 3).tolist() == []


def test_chunks_cover_everything():
    sizes = [1, 10, 100, 3, 0, 7, 7]
    parts = list(common.chunks(sizes, 10))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(7))
    assert list(common.chunks([], 10)) == []
