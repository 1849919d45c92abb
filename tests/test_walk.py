import numpy as np
import pytest

from litomics.operators import scoring


def random_graph(rng, n, m):
    source, target = rng.integers(0, n, m), rng.integers(0, n, m)
    pairs = np.unique(source * n + target)
    source, target = pairs // n, pairs % n
    weight = rng.choice([-1.0, 1.0, 0.3], len(pairs))
    total = np.zeros(n)
    np.add.at(total, source, np.abs(weight))
    return source, target, weight / total[source]


@pytest.mark.parametrize("n, m, numbers", [(1, 0, 10), (6, 4, 10), (40, 120, 200), (200, 600, 4_000_000)])
def test_sparse_walks_equal_dense_ones(monkeypatch, n, m, numbers):
    monkeypatch.setattr(scoring, "STEP_NUMBERS", numbers)
    rng = np.random.default_rng(n)
    source, target, weight = random_graph(rng, n, m) if m else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    seeds, onto = np.arange(0, n, 2), np.arange(0, n, 3)
    want = scoring.influence(scoring.dense(n, source, target, weight), np.eye(n)[seeds])[:, onto]
    got = scoring.Compressed(n, source, target, weight).influence(seeds, onto)
    assert np.abs(want - got).max() < 1e-9


def plain_scores(nodes, edges, seeds, readouts, samples, n_permutations, unsigned=0.3):
    """From tables to rows, with a dense matrix for each pathway."""
    out = []
    for pathway in sorted({r[0] for r in readouts}):
        mine = sorted((i, t, g) for p, i, t, g in nodes if p == pathway and t != "map")
        ids = [i for i, _, _ in mine]
        place = {i: k for k, i in enumerate(ids)}
        inner = [(place[a], place[b], s) for p, a, b, s in edges if p == pathway and a in place and b in place]
        total = {}
        for a, _, s in inner:
            total[a] = total.get(a, 0) + (abs(s) or unsigned)
        w = np.zeros((len(ids), len(ids)))
        for a, b, s in inner:
            w[a, b] += (s or unsigned) / total[a]
        degree = np.zeros(len(ids), int)
        for a, _, _ in inner:
            degree[a] += 1
        for k in range(len(ids)):
            if not degree[k]:
                w[k, k] = 1.0
        carriers = [k for k, (_, t, g) in enumerate(mine) if t in ("gene", "ortholog") and g]
        f = scoring.influence(w, np.eye(len(ids))[carriers]) if carriers else np.zeros((0, len(ids)))
        order = np.argsort(degree[carriers], kind="stable")
        quartile = np.empty(len(carriers), int)
        quartile[order] = np.arange(len(carriers)) * 4 // max(1, len(carriers))
        for sample in samples:
            y = np.zeros(len(ids))
            for p, i, s, v in readouts:
                if p == pathway and s == sample and i in place:
                    y[place[i]] += v
            genes = {}
            for k, c in enumerate(carriers):
                genes.setdefault(mine[c][2].upper(), []).append(k)
            own = [(g.upper(), v) for s, g, v in seeds if s == sample]
            start = np.zeros(len(carriers))
            for g, v in own:
                for k in genes.get(g, []):
                    start[k] += v / len(genes[g])
            at = np.flatnonzero(start)
            on = sum(g in genes for g, _ in own)
            total_abs = np.abs(start).sum()
            if not total_abs:
                value, mean, sd, p, n = 0.0, 0.0, 0.0, 1.0, 0
            else:
                rho, share = f @ y, start[at] / total_abs
                r = scoring.draws(42, pathway, sample, n_permutations, len(at))
                null = np.array([sum(s * rho[(pool := np.flatnonzero(quartile == quartile[k]))[int(r[b, j] % np.uint64(len(pool)))]] for j, (k, s) in enumerate(zip(at, share))) for b in range(n_permutations)])
                value, mean, n = float(share @ rho[at]), float(null.mean()), n_permutations
                sd = float(np.sqrt(max(0.0, (null**2).mean() - mean**2)))
                p = (1 + (np.abs(null) >= abs(value)).sum()) / (1 + n)
            out.append((pathway, sample, value, mean, sd, (value - mean) / sd if sd else 0.0, p, n, on, len(own) - on, int((y != 0).sum())))
    return out


def test_scores_from_tables_with_map_nodes(spark):
    """A node of type map takes no weight: edges that lead to it leave before weights are shared out."""
    rng = np.random.default_rng(3)
    kinds = ["gene", "gene", "gene", "ortholog", "compound", "map"]
    nodes = [(p, i, kinds[rng.integers(6)], f"G{rng.integers(9)}" if rng.random() < 0.9 else "") for p in (1, 2) for i in range(14)]
    edges = list({(p, int(a), int(b)): (p, int(a), int(b), int(rng.integers(-1, 2))) for p in (1, 2) for a, b in rng.integers(0, 15, (40, 2))}.values())
    seeds = [(s, f"g{g}", float(rng.normal())) for s in range(5) for g in range(0, 9, 1 + s % 3)]
    readouts = [(1, i, s, float(rng.normal())) for i in range(0, 16, 3) for s in range(6)] + [(2, 4, 1, 1.5)]
    samples = list(range(6))
    frames = [
        spark.createDataFrame(nodes, "pathway_id long, node_id long, node_type string, gene string"), spark.createDataFrame(edges, "pathway_id long, source long, target long, sign int"),
        spark.createDataFrame(seeds, "sample_id long, gene string, weight double"), spark.createDataFrame(readouts, "pathway_id long, node_id long, sample_id long, value double"), spark.createDataFrame([(s,) for s in samples], "sample_id long"),
    ]
    got = sorted(map(tuple, scoring.score(*frames, n_permutations=40).collect()))
    want = plain_scores(nodes, edges, seeds, readouts, samples, 40)
    assert len(got) == len(want) == 12
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[7:] == w[7:] and np.allclose(g[2:7], w[2:7], atol=1e-9), (g, w)
    assert any(r[2] for r in got) and any(k == "map" for _, _, k, _ in nodes)
