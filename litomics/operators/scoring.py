"""Pathway scores by signed random walk with restart, and their permutation null.

The walk is linear in its seeds, so each pathway's influence is worked out once, in a task of its own, over the graph's edges in compressed rows; a score is then a dot product. Scores are
dealt by (pathway, block of samples): the influence of the nodes that carry genes on those with readouts goes to each of its blocks, of which there are as many as
the samples need. Nodes of type `map` stand for whole pathways: they and their edges leave the graph before edges get weights. Draws depend on (seed, pathway, sample, permutation) alone, so results do not depend on how work is dealt."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topology import adjacency

RESTART, MOST_STEPS, CLOSE = 0.3, 100, 1e-8
#: Samples that one task scores on one pathway.
BLOCK_SAMPLES = 2000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def splitmix(x: np.ndarray) -> np.ndarray:
    z = x + _GOLDEN
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def draws(seed: int, pathway: int, sample: int, n: int, count: int) -> np.ndarray:
    """(n, count) 64-bit numbers: row b is the stream of permutation b."""
    with np.errstate(over="ignore"):
        state = splitmix(np.full(n, seed, np.uint64) ^ np.uint64(pathway & (2**64 - 1)))
        state = splitmix(state ^ np.uint64(sample & (2**64 - 1)))
        state = splitmix(state ^ np.arange(n, dtype=np.uint64))
        state = np.where(state == 0, _GOLDEN, state)
        out = np.empty((n, count), np.uint64)
        for k in range(count):
            state = state ^ (state >> np.uint64(12))
            state = state ^ (state << np.uint64(25))
            state = state ^ (state >> np.uint64(27))
            out[:, k] = state * np.uint64(0x2545F4914F6CDD1D)
    return out


def influence(weights: np.ndarray, starts: np.ndarray, restart: float = RESTART) -> np.ndarray:
    """One walk from each row of `starts`; weights[i, j] leads from i to j. Each walk stops when its own change is small."""
    p, live = starts.copy(), np.ones(len(starts), bool)
    for _ in range(MOST_STEPS):
        if not live.any():
            break
        new = (1 - restart) * (p[live] @ weights) + restart * starts[live]
        change = np.abs(new - p[live]).sum(axis=1)
        p[live] = new
        at = np.flatnonzero(live)
        live[at[change < CLOSE]] = False
    return p


#: Numbers that one step of the walks holds at once: seeds by edges.
STEP_NUMBERS = 4_000_000


class Compressed:
    """The edges of a graph by target: where each target's edges begin, their sources and weights. A node without edges out keeps its mass."""

    def __init__(self, n: int, source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        without = np.setdiff1d(np.arange(n), source)
        source, target, weight = np.concatenate([source, without]), np.concatenate([target, without]), np.concatenate([weight, np.ones(len(without))])
        order = np.argsort(target, kind="stable")
        self.n, self.source, self.weight = n, source[order], weight[order]
        self.targets, self.starts = np.unique(target[order], return_index=True)

    def step(self, p: np.ndarray) -> np.ndarray:
        """One step of each row of `p`."""
        out = np.zeros((len(p), self.n))
        if len(self.targets):
            out[:, self.targets] = np.add.reduceat(p[:, self.source] * self.weight, self.starts, axis=1)
        return out

    def influence(self, seeds: np.ndarray, onto: np.ndarray, restart: float = RESTART) -> np.ndarray:
        """The walk from each node of `seeds`, as it stands on the nodes `onto`. Walks go in blocks, so that memory follows edges and results, not nodes by nodes."""
        out = np.empty((len(seeds), len(onto)))
        size = max(1, STEP_NUMBERS // max(self.n, len(self.source), 1))
        for at in range(0, len(seeds), size):
            some = seeds[at : at + size]
            p = np.zeros((len(some), self.n))
            p[np.arange(len(some)), some] = 1.0
            live = np.arange(len(some))
            for _ in range(MOST_STEPS):
                if not len(live):
                    break
                new = (1 - restart) * self.step(p[live])
                new[np.arange(len(live)), some[live]] += restart
                change = np.abs(new - p[live]).sum(axis=1)
                p[live] = new
                live = live[change >= CLOSE]
            out[at : at + size] = p[:, onto]
        return out


def dense(n: int, source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weight matrix, for graphs small enough; a node without edges out keeps its mass."""
    w = np.zeros((n, n))
    np.add.at(w, (source, target), weight)
    without = np.setdiff1d(np.arange(n), source)
    w[without, without] = 1.0
    return w


def quartiles(degree: np.ndarray) -> np.ndarray:
    out = np.empty(len(degree), int)
    order = np.argsort(degree, kind="stable")
    out[order] = np.arange(len(degree)) * 4 // max(1, len(degree))
    return out


def null_and_score(nodes: np.ndarray, values: np.ndarray, rho: np.ndarray, quartile: np.ndarray, n: int, seed: int, pathway: int, sample: int) -> tuple[float, float, float, float, int]:
    """(score, null mean, null sd, p, permutations) of seeds at `nodes` (ascending); degenerate without seeds."""
    total = float(np.abs(values).sum())
    if total <= 0 or n == 0 or not len(nodes):
        return 0.0, 0.0, 0.0, 1.0, 0
    share = values / total
    observed = float(share @ rho[nodes])
    r = draws(seed, pathway, sample, n, len(nodes))
    moved = np.empty((n, len(nodes)))
    for k, node in enumerate(nodes):
        pool = np.flatnonzero(quartile == quartile[node])
        moved[:, k] = rho[pool[(r[:, k] % np.uint64(len(pool))).astype(np.int64)]]
    null = moved @ share
    mean = float(null.mean())
    sd = float(np.sqrt(max(0.0, float((null * null).mean()) - mean * mean)))
    return observed, mean, sd, (1 + int((np.abs(null) >= abs(observed)).sum())) / (1 + n), n


SCORES = "pathway_id long, sample_id long, score double, null_mean double, null_sd double, z_score double, p_empirical double, n_permutations int, n_seeds_on_graph int, n_seeds_off_graph int, n_readout_nodes int"


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """pathway_id, node_id, gene of the nodes that a walk visits; null for a gene that carries no seed."""
    if "node_type" not in nodes.columns:
        return nodes.select("pathway_id", "node_id", "gene")
    carries = F.col("node_type").isin("gene", "ortholog") & (F.col("gene") != "")
    return nodes.where("node_type is null or node_type <> 'map'").select("pathway_id", "node_id", F.when(carries, F.col("gene")).alias("gene"))


def inner_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes; the others go before weights are shared out, so they take none."""
    end = lambda name: nodes.select("pathway_id", F.col("node_id").alias(name))
    return edges.join(end("source"), ["pathway_id", "source"], "left_semi").join(end("target"), ["pathway_id", "target"], "left_semi")


def score(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, readouts: DataFrame, samples: DataFrame, n_permutations: int = 200, seed: int = 42, unsigned: float = 0.3, restart: float = RESTART) -> DataFrame:
    """A row for each (pathway with a readout, sample).

    nodes: pathway_id, node_id, gene (null for nodes that carry no seed), in order of node_id; with node_type, those of type map go and only genes and orthologs carry seeds. edges: pathway_id, source, target, sign. seeds: sample_id,
    gene, weight. readouts: pathway_id, node_id, sample_id, value (already averaged by rule). samples: sample_id."""
    n_blocks = 1 + samples.count() // BLOCK_SAMPLES
    blocks = samples.select("sample_id", F.pmod(F.xxhash64("sample_id"), F.lit(n_blocks)).cast("int").alias("block"))
    with_readout = readouts.select("pathway_id").distinct()
    nodes = graph_nodes(nodes)
    weighted = adjacency(inner_edges(nodes, edges), unsigned)
    read = readouts.join(nodes.select("pathway_id", "node_id"), ["pathway_id", "node_id"], "left_semi").groupBy("pathway_id").agg(F.array_sort(F.collect_set("node_id")).alias("read"))
    graph = (
        nodes.join(with_readout, "pathway_id", "left_semi").groupBy("pathway_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "gene"))).alias("nodes"))
        .join(read, "pathway_id", "left")
        .join(weighted.groupBy("pathway_id").agg(F.collect_list(F.struct("source", "target", "weight")).alias("edges")), "pathway_id", "left")
    )
    all_genes = seeds.groupBy("sample_id").agg(F.count("*").alias("n_seeds"))
    on_graph = nodes.where("gene is not null").select("pathway_id", F.upper("gene").alias("gene")).distinct().join(seeds.select("sample_id", F.upper("gene").alias("gene"), "weight"), "gene")
    seed_lists = on_graph.groupBy("pathway_id", "sample_id").agg(F.collect_list(F.struct("gene", "weight")).alias("seeds"))
    values = readouts.groupBy("pathway_id", "sample_id").agg(F.collect_list(F.struct("node_id", "value")).alias("values"))
    pairs = with_readout.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "block")
    work = (
        pairs.join(seed_lists, ["pathway_id", "sample_id"], "left").join(values, ["pathway_id", "sample_id"], "left").join(all_genes, "sample_id", "left")
        .select("pathway_id", "block", "sample_id", "seeds", "values", F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"))
    )

    def prepare(rows: pd.DataFrame) -> pd.DataFrame:
        """The influence of each node that carries a gene on each node with a readout, and what scores need of the graph."""
        out = []
        for g in rows.itertuples():
            ids = [int(n["node_id"]) for n in g.nodes]
            place = {v: i for i, v in enumerate(ids)}
            e = g.edges if g.edges is not None else []
            source, target = (np.array([place[int(x[c])] for x in e], int) for c in ("source", "target"))
            read = [int(x) for x in g.read] if g.read is not None else []
            carriers = np.array([i for i, n in enumerate(g.nodes) if n["gene"]], int)
            f = Compressed(len(ids), source, target, np.array([x["weight"] for x in e], float)).influence(carriers, np.array([place[x] for x in read], int), restart)
            quartile = quartiles(np.bincount(source, minlength=len(ids))[carriers]) if len(carriers) else np.zeros(0, int)
            out.append((g.pathway_id, read, [g.nodes[i]["gene"].upper() for i in carriers], quartile.tolist(), f.tobytes()))
        return pd.DataFrame(out, columns=["pathway_id", "ids", "genes", "quartile", "influence"])

    ready = graph.groupBy("pathway_id").applyInPandas(prepare, "pathway_id long, ids array<long>, genes array<string>, quartile array<int>, influence binary")

    def run(key: tuple, rows: pd.DataFrame, graphs: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(graphs):
            return pd.DataFrame(columns=[c.split()[0] for c in SCORES.split(", ")])
        pathway = int(key[0])
        g = graphs.iloc[0]
        place = {int(v): i for i, v in enumerate(g["ids"])}
        genes: dict[str, list[int]] = {}
        for i, gene in enumerate(g["genes"]):
            genes.setdefault(gene, []).append(i)
        f, quartile = np.frombuffer(g["influence"]).reshape(len(g["genes"]), len(place)), np.array(g["quartile"], int)
        out = []
        for r in rows.itertuples():
            y = np.zeros(len(place))
            for v in r.values if r.values is not None else []:
                if int(v["node_id"]) in place:
                    y[place[int(v["node_id"])]] += v["value"]
            s = np.zeros(len(f))
            mine = sorted(((x["gene"], x["weight"]) for x in r.seeds), key=lambda x: x) if r.seeds is not None else []
            for gene, weight in mine:
                for i in genes[gene]:
                    s[i] += weight / len(genes[gene])
            at = np.flatnonzero(s)
            value, mean, sd, p, n = null_and_score(at, s[at], f @ y, quartile, n_permutations, seed, pathway, int(r.sample_id))
            out.append((pathway, int(r.sample_id), value, mean, sd, (value - mean) / sd if sd else 0.0, p, n, len(mine), int(r.n_seeds) - len(mine), int((y != 0).sum())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCORES.split(", ")])

    spread = ready.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return work.groupBy("pathway_id", "block").cogroup(spread.groupBy("pathway_id", "block")).applyInPandas(run, SCORES)
