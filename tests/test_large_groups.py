import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from litomics.operators import filters, links, selection


def plain(rows):
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    return {k: float(np.mean([sorted(v)[(len(v) - 1) // 2], sorted(v)[len(v) // 2]])) for k, v in groups.items()}


@pytest.mark.parametrize("most", [10**9, 5, 0])
def test_medians(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "MOST_VALUES", most)
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e9), 0.0, -0.0, 1e-300, -1e300, 5.0, 5.0, None])) for k in range(12) for _ in range(rng.randrange(1, 60))]
    rows += [(None, 2.0), (None, 4.0), (50, 7.0), (51, None), (52, 1.0), (52, 1.0), (53, -3.0), (53, -1.0), (53, -2.0)]
    got = {r["k"]: r["median"] for r in selection.medians(spark.createDataFrame(rows, "k long, v double").repartition(3), ["k"], "v").collect()}
    want = plain(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-12 * max(1, abs(want[k])) for k in want)


def test_histograms_stay_small(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(1, float(v)) for v in rng.normal(size=20_001)], "k long, v double")
    assert selection.by_histograms(rows, ["k"], "v").first()["median"] == float(np.median([r["v"] for r in rows.collect()]))


@pytest.mark.parametrize("tile", [2000, 7, 1])
def test_pairs_of_large_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(links, "TILE_ITEMS", tile)
    rng = random.Random(6)
    rows = [(g, rng.randrange(40)) for g in range(6) for _ in range(rng.choice([1, 3, 60]))] + [(None, 1), (None, 2), (3, None)]
    want = Counter()
    for g in range(6):
        want.update(combinations(sorted({i for h, i in rows if h == g and i is not None}), 2))
    got = {(r["a"], r["b"]): r["n_groups"] for r in links.co_occurring(spark.createDataFrame(rows, "g long, i long"), "g", "i").collect()}
    assert got == dict(want)


def test_a_large_group_is_dealt_over_tasks(spark):
    rows = spark.range(50_000).selectExpr("1 as g", "id as i")
    sizes = [r["count"] for r in links.tiles(rows, "g", "i", "a").groupBy("g", "_low", "_high").count().collect()]
    assert len(sizes) == 25 * 26 // 2 and max(sizes) < 2 * 2400


def test_gene_hits_of_json(spark):
    cases = [('{"contract": {"monogenic_gene_hit": {"genes": ["A"]}}}', True), ('{"contract": {"monogenic_gene_hit": {"genes": []}}}', False), ('{"contract": {"monogenic_gene_hit": {}}}', False), ('{"contract": {"monogenic_gene_hit": null}}', False),
             ('{"contract": {}}', False), ("{}", False), ("no json", False), (None, False), ('{"contract": {"monogenic_gene_hit": {"genes": [ ]}}}', False), ('{"monogenic_gene_hit": {"genes": ["A"]}}', False)]
    got = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m string").select("i", filters.has_gene_hit(filters.F.col("m")).alias("h")).collect()
    assert [r["h"] for r in sorted(got)] == [h for _, h in cases]
    rows = spark.createDataFrame([(1, "mixed", None, 5), (2, "complex", cases[0][0], 4), (3, "monogenic", cases[0][0], 3), (4, None, cases[0][0], 2), (5, "complex", "{}", 1)], "id int, axis string, metadata string, added_at int")
    assert [(r["id"], r["reason"]) for r in filters.high_value_queue(rows).collect()] == [(1, "mixed"), (4, "discordance"), (2, "discordance")]
