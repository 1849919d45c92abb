import random

import numpy as np
import pytest

from litomics.operators import fdr


def rows_of(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 1, 1, 2, 3, None]), i % 5, rng.choice([0.0, 1.0, 1.0, 1.0, None]), round(rng.random() ** 3, 2)) for i in range(n)]


SCHEMA = "id long, pathway_id long, sample_id long, null_sd double, p_empirical double"


def plain(rows, at):
    """q and family size by a plain loop over each sorted family."""
    out = {r[0]: (None, 0) for r in rows}
    for family in {r[at] for r in rows}:
        tests = sorted((r[4], r[0]) for r in rows if r[at] == family and r[3])
        low = 1.0
        for k in range(len(tests), 0, -1):
            low = min(low, tests[k - 1][0] * len(tests) / k)
            out[tests[k - 1][1]] = (low, len(tests))
    return out


@pytest.mark.parametrize("most, chunk", [(1_000_000, 100_000), (50, 7), (50, 1000), (0, 1)])
@pytest.mark.parametrize("scope, at", [("population", 1), ("individual", 2)])
def test_families_of_any_size(spark, monkeypatch, most, chunk, scope, at):
    monkeypatch.setattr(fdr, "MOST_TESTS", most)
    monkeypatch.setattr(fdr, "CHUNK_TESTS", chunk)
    rows = rows_of(600, 3)
    suffix = fdr.SCOPES[scope][1]
    got = {r["id"]: (r[f"q_value_{suffix}"], r[f"fdr_n_tests_{suffix}"]) for r in fdr.adjust(spark.createDataFrame(rows, SCHEMA).repartition(5), scope).collect()}
    want = plain(rows, at)
    assert got.keys() == want.keys()
    for i, (q, m) in want.items():
        assert got[i][1] == m and (q is None) == (got[i][0] is None) and (q is None or abs(q - got[i][0]) < 1e-12), i


def test_one_family_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(fdr, "MOST_TESTS", 1000)
    monkeypatch.setattr(fdr, "CHUNK_TESTS", 500)
    rng = np.random.default_rng(1)
    rows = [(i, 1, i, 1.0, float(p)) for i, p in enumerate(rng.random(6000))]
    tests, q, m = fdr.ranked_by_ranges(spark.createDataFrame(rows, SCHEMA), "pathway_id")
    sizes = [r["count"] for r in tests.groupBy("_f", "_chunk").count().collect()]
    assert len(sizes) == 12 and max(sizes) == 500
    monkeypatch.setattr(fdr, "MOST_TESTS", 10**9)
    one = {r["id"]: r["q_value_across_samples"] for r in fdr.adjust(spark.createDataFrame(rows, SCHEMA), "population").collect()}
    assert all(abs(one[r["id"]] - r["q"]) < 1e-12 for r in tests.select("id", q.alias("q")).collect())


def test_empty(spark):
    assert fdr.adjust(spark.createDataFrame([], SCHEMA), "population").collect() == []
