"""Quality rules, judged by an isolation forest on rule statistics.

Rules first give counts per document. Documents that fail the base rules are rejected. For the others a forest of random
splits, grown on labelled rows of both kinds, gives a mean path length: rows that few random splits set apart are anomalous.

Labels calibrate two things. A split draws its statistic at random, with a chance that follows how well random splits on that
statistic alone tell bad labelled rows from good ones; so a good text with an unusual share of digits, say, is not set apart sooner
than a bad one. And a document is kept if its path length is over the threshold at which the share of bad labelled rows that
go, less PRICE times the share of good ones, is greatest. Nothing but the path length decides.

All labelled documents decide the chances and the threshold: their path lengths are counted in steps of 1 / STEPS, in tasks. Only the rows that
trees are grown on, SAMPLE a tree as the method has it, are drawn: by a hash of doc_id from all of them, as many as all trees together take.
Labels meet the counts of the rules, never the texts: a filter of fixed size says which texts are counted, and their rows without text are shuffled.

Nulls: a null text has no words and fails the base rules; a null label is no label. Without LEAST_ROWS good labelled rows there is no forest
and the base rules decide; without bad ones every statistic has the same chance and the threshold lets FALSE_REJECTS of the good
rows go. Repeated rows stay. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LISTED, discard, gram_hashes, marked, mix, places, small_batches, staged, table, text_chunks, word_hashes

LEAST_ROWS = 32
#: Steps of a path length in which labelled rows are counted.
STEPS = 1024
N_TREES = 150
#: Rows that a tree is grown on; few, so that bad rows do not hide each other.
SAMPLE = 64
#: Trees on one statistic alone, by which its chance to be drawn is found.
PROBES = 25
FALSE_REJECTS = 0.002
#: Bad rows that a good row weighs, by their shares.
PRICE = 5.0
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_marks")
STATS_SCHEMA = ", ".join(f"{c} long" for c in (*COUNTS, *EXTRA))

SPACE = bytes([*range(9, 14), 32])
NOT_STARTS = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"!?;:()[]{}/\\=+_~^@\"'"


def _without(text: bytes, gone: bytes) -> int:
    return len(text) - len(text.translate(None, gone))


def rule_counts(texts: list[bytes]) -> np.ndarray:
    """One row of COUNTS and EXTRA for each text."""
    words = [t.split() for t in texts]
    hashes, starts = word_hashes(words)
    out = np.zeros((len(texts), len(COUNTS) + len(EXTRA)), np.int64)
    out[:, 0] = np.diff(starts)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[i, 1] = len(t.translate(None, SPACE + NOT_STARTS))
        out[i, 2] = _without(t, SYMBOLS)
        out[i, 3] = len(lines) - len(set(lines))
        out[i, 5:] = len(lines), _without(t, UPPER), _without(t, DIGITS), _without(t, MARKS)
    at = places(starts, 3)
    if len(at):
        owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(starts))
        keys = gram_hashes(hashes, 3)[at] ^ mix(owner[at] + np.uint64(1))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(hashes) + 1, np.int64)
        for k in range(3):
            covered[at[twice] + k] = 1
        total = np.concatenate([[0], np.cumsum(covered[:-1])])
        out[:, 4] = total[starts[1:]] - total[starts[:-1]]
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Rates of the rules; none depends on the document's length alone."""
    c = counts.astype(float)
    words, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 5], 1)
    return np.stack([c[:, 1] / words, c[:, 2] / words, c[:, 3] / lines, c[:, 4] / words, c[:, 6] / chars, c[:, 7] / chars, c[:, 8] / words], axis=1)


def _unsplit(n: float) -> float:
    """Mean path length of n rows that are not split further."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Trees as arrays: feature (-1 at a leaf), value, left and right child, path length at leaves.

    `chances` are those of the statistics to be drawn at a split, equal by default."""

    def __init__(self, rows: np.ndarray, chances: np.ndarray | None = None, n_trees: int = N_TREES, sample: int = SAMPLE, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        sample = min(sample, len(rows))
        self.most = math.ceil(math.log2(max(2, sample)))
        chances = np.ones(rows.shape[1]) if chances is None else chances
        self.trees = [self._grown(rows[rng.choice(len(rows), sample, replace=False)], chances, rng) for _ in range(n_trees)]

    def _grown(self, rows: np.ndarray, chances: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        nodes: list[list[float]] = []
        todo = [(rows, 0, -1, 0)]
        while todo:
            x, depth, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            low, high = x.min(axis=0), x.max(axis=0)
            chance = np.where(high > low, chances, 0.0)
            if depth >= self.most or len(x) <= 1 or not chance.sum() > 0:
                nodes.append([-1, 0.0, at, at, depth + _unsplit(len(x))])
                continue
            f = int(rng.choice(len(chance), p=chance / chance.sum()))
            value = rng.uniform(low[f], high[f])
            nodes.append([f, value, 0, 0, 0.0])
            below = x[:, f] < value
            todo += [(x[below], depth + 1, at, 0), (x[~below], depth + 1, at, 1)]
        a = np.array(nodes)
        return a[:, 0].astype(int), a[:, 1], a[:, 2:4].astype(int), a[:, 4]

    def path_lengths(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length by row."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, value, children, length in self.trees:
            at = np.zeros(len(rows), int)
            for _ in range(self.most):
                f = feature[at]
                right = rows[every, np.maximum(f, 0)] >= value[at]
                at = np.where(f < 0, at, children[at, right.astype(int)])
            total += length[at]
        return total / len(self.trees)


def told_apart(length: np.ndarray, bad: np.ndarray) -> float:
    """The chance that a bad row has a shorter path than a good one; ties count half."""
    _, rank = np.unique(length, return_inverse=True)
    n = np.bincount(rank)
    middle = (np.cumsum(n) - (n - 1) / 2)[rank]
    n_bad = int(bad.sum())
    return float(1 - (middle[bad].sum() - n_bad * (n_bad + 1) / 2) / (n_bad * (len(bad) - n_bad)))


def told_apart_by_counts(n_bad: np.ndarray, n_good: np.ndarray) -> float:
    """The same from the numbers of bad and good rows at each length, shortest first."""
    longer = n_good.sum() - np.cumsum(n_good)
    return float((n_bad * (longer + n_good / 2)).sum() / (n_bad.sum() * n_good.sum()))


def least_kept(step: np.ndarray, n_bad: np.ndarray, n_good: np.ndarray) -> float:
    """The least path length that is kept, from the numbers of rows at each step of length, shortest first."""
    if not n_bad.sum():
        gone = np.cumsum(n_good) <= FALSE_REJECTS * n_good.sum()
        return float(step[int(gone.sum())]) / STEPS
    gain = np.concatenate([[0.0], np.cumsum(n_bad) / n_bad.sum() - PRICE * np.cumsum(n_good) / n_good.sum()])
    k = int(gain.argmax())
    # any number behind the last step that goes and up to the first that stays parts the rows alike
    first, last = (step[0] - STEPS if k == 0 else step[k - 1] + 1), (step[k] if k < len(step) else step[-1] + 1)
    return float((first + last) // 2) / STEPS


def lengths_counted(rows: DataFrame, forests: list[IsolationForest]) -> list[np.ndarray]:
    """For each forest: step of path length, number of bad and of good rows, by step. rows: COUNTS, EXTRA, bad."""
    sent = rows.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*COUNTS, *EXTRA)], axis=1))
            bad = batch.column("bad").to_numpy(zero_copy_only=False).astype(bool)
            for k, forest in enumerate(sent.value):
                step, at = np.unique(np.floor(forest.path_lengths(x) * STEPS).astype(np.int64), return_inverse=True)
                n_bad, n = np.bincount(at[bad], minlength=len(step)), np.bincount(at, minlength=len(step))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(step), k)), pa.array(step), pa.array(n_bad), pa.array(n - n_bad)], ["forest", "step", "bad", "good"])

    counted = rows.mapInArrow(run, "forest long, step long, bad long, good long").groupBy("forest", "step").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = counted.orderBy("forest", "step").toPandas().to_numpy(np.int64).reshape(-1, 4)
    return [found[found[:, 0] == k, 1:] for k in range(len(forests))]


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def measured(docs: DataFrame) -> DataFrame:
    """The rules' counts beside the other columns of `docs`, without the text."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            counts = rule_counts(texts)
            columns = [*(part.column(c) for c in rest), *(pa.array(counts[:, i]) for i in range(counts.shape[1]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, *COUNTS, *EXTRA])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ("," if rest else "") + STATS_SCHEMA)


def drawn(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """COUNTS and EXTRA of the `most` rows of least hash of doc_id, or of all n if they are fewer.

    Only rows under a bound that lets about twice as many pass leave their tasks; where many rows share an id and too few pass, there is no bound."""
    place = F.xxhash64("doc_id", F.lit(17))
    low = rows.where(place < F.lit(min((1 << 63) - 1, 2 * most * (1 << 64) // n - (1 << 63))))
    for some in (low, rows):
        found = some.orderBy(place, "doc_id", *COUNTS).limit(most).select(*COUNTS, *EXTRA).toPandas().to_numpy(np.int64)
        if len(found) == min(most, n):
            break
    return found


def fit(docs: DataFrame, labels: DataFrame) -> tuple[IsolationForest, float] | None:
    """The forest and the least path length that is kept, from all labelled documents."""
    # ids of one type have one hash
    ids = labels.withColumn("doc_id", F.col("doc_id").try_cast(dict(docs.dtypes)["doc_id"]))
    chosen = ids.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counted = measured(marked(docs.select("doc_id", "text"), chosen).where(LISTED).drop(LISTED))
    rows = staged(counted.join(chosen, "doc_id").withColumn("bad", F.col("quality") != 1), "labelled")
    past = rows.where((F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words")))
    n, n_bad = past.agg(F.count("*"), F.count_if("bad")).first()
    if n - n_bad < LEAST_ROWS:
        discard(rows)
        return None
    k = features(np.zeros((1, len(COUNTS) + len(EXTRA)))).shape[1]
    grown = features(drawn(past, n, (k * PROBES + N_TREES) * SAMPLE))
    chances = None
    if n_bad:
        alone = lengths_counted(past, [IsolationForest(grown, np.eye(k)[f], PROBES) for f in range(k)])
        chances = np.maximum(2 * np.array([told_apart_by_counts(c[:, 1], c[:, 2]) for c in alone]) - 1, 0.0)
        chances = chances if chances.sum() > 0 else None
    forest = IsolationForest(grown, chances)
    least = least_kept(*lengths_counted(past, [forest])[0].T)
    discard(rows)
    return forest, least


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and path_length of every row of `docs`."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            counts = rule_counts(texts)
            failed = base_failed(counts)
            length, kept = np.full(len(texts), np.nan), ~failed
            if sent.value is not None:
                forest, least = sent.value
                length = forest.path_lengths(features(counts))
                kept &= length >= least
            columns = [part.column("doc_id"), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(kept), pa.array(length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "kept", "path_length"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, path_length double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules and the forest keep, unchanged; one pass, without a join."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            counts = rule_counts(texts)
            kept = ~base_failed(counts)
            if sent.value is not None:
                forest, least = sent.value
                kept &= forest.path_lengths(features(counts)) >= least
            yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op2_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
