"""Best-fit packing of tokenised documents by a linear grouping scheme.

Pieces longer than SMALL are sorted by length and cut into groups of equal cardinality; lengths are rounded up to their group's
largest, which leaves few sizes. Column generation finds configurations of these sizes that fill few sequences. Actual
documents are substituted for the rounded ones, but for the smallest of each configuration; these and all small pieces then go,
longest first, where they fit best, so that the room that rounding left is used too.

The plan needs only how many pieces there are of each length, CAPACITY numbers at most, so the driver's work does not grow with the corpus. It is
a list of (lengths in a sequence, how many such sequences); a piece finds its sequence from its length and its number
among the pieces of that length. Numbers are given in parallel, a common length's in buckets.

A document is its byte-level BPE ids and then END. Longer ones are cut into pieces of CAPACITY; the first piece may be shorter.

Nulls: a null text is empty, one piece of END alone; a null doc_id is a key like others. Repeated rows are packed each. An
empty table gives an empty result. No text is cut short.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, small_batches, staged, table, text_chunks

CAPACITY = 1024
END = 2
SMALL = 128
GROUPS = 96
#: Column generation ends when its bound says that no packing of the rounded sizes is better by more than this part.
CLOSE = 0.0005
TOKENIZER = "byte_bpe_50k"
#: Special strings of the vocabulary, and runs of blanks or of other bytes that the faster encoder takes long over or fails at, go to the slower
#: one. Both give the same ids.
SPECIAL = b"<|endoftext|>"
LONG_RUN = 2000
_BLANK = np.isin(np.arange(256), [*range(9, 14), 32])


def longest_run(text: bytes) -> int:
    """Most bytes in a row that are all blanks or all not."""
    blank = _BLANK[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(blank)) + 1
    return int(np.diff(np.concatenate([[0], edges, [len(blank)]])).max())


class Encoder:
    """Ids of a public byte-level BPE. Two libraries read the same vocabulary; the faster one takes ordinary text."""

    def __init__(self, name: str = TOKENIZER) -> None:
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.name, self.slow = name, None

    def __call__(self, text: bytes) -> np.ndarray:
        if SPECIAL not in text and (len(text) < LONG_RUN or longest_run(text) < LONG_RUN):
            ids = self.fast.encode_to_numpy(text.decode(), disallowed_special=())
        else:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
            ids = self.slow.encode(text.decode(), add_special_tokens=False).ids
        return np.append(np.asarray(ids, "<u4"), np.array([END], "<u4"))


def tokenised(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ids themselves are not kept."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder()
        for part, texts in text_chunks(batches):
            owner, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(texts):
                ids = encode(text)
                raw = ids.tobytes()
                at, k = 0, 0
                while at < len(ids):
                    n = (len(ids) - at) % capacity or capacity
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    at, k = at + n, k + 1
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# --- the plan, from counts by length ----------------------------------------------------------------------------------

Runs = list[tuple[tuple[int, ...], int]]


def grouped(counts: np.ndarray, small: int, n_groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Linear grouping of lengths above `small`: (rounded size, [(length, how many)]), longest first, groups of equal cardinality."""
    total = int(counts[small + 1 :].sum())
    n_groups = max(1, min(n_groups, int((counts[small + 1 :] > 0).sum())))
    ends = [total * (g + 1) // n_groups for g in range(n_groups)]
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    done, g, new = 0, 0, True
    for length in range(len(counts) - 1, small, -1):
        left = int(counts[length])
        while left:
            take = min(left, ends[g] - done)
            if take:
                if new and not (groups and groups[-1][0] == length):
                    groups.append((length, []))
                groups[-1][1].append((length, take))
                new = False
            done, left = done + take, left - take
            if done == ends[g] and g + 1 < n_groups:
                g, new = g + 1, True
    return groups


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most_steps: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used in an optimal fractional packing (column generation, revised simplex)."""
    k = len(sizes)
    columns = [np.eye(k)[i] * (capacity // sizes[i]) for i in range(k)]
    inverse = np.diag([1 / (capacity // s) for s in sizes])
    x = inverse @ demand
    every = np.arange(capacity + 1)
    before = every[:, None] - sizes[None]
    fits, before = before >= 0, np.maximum(before, 0)
    for _ in range(most_steps):
        worth = inverse.sum(axis=0)
        best, picks = np.zeros(capacity + 1), []
        for _ in range(capacity // int(sizes.min())):  # one item more in each round
            value = np.where(fits, best[before] + worth, -1)
            pick = value.argmax(axis=1)
            value = value[every, pick]
            pick[value <= best + 1e-12] = -1
            picks.append(pick)
            best = np.maximum(best, value)
        if best[capacity] <= 1 + CLOSE:
            break
        column, c = np.zeros(k), capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                column[pick[c]] += 1
                c -= int(sizes[pick[c]])
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.maximum(d, 1e-9), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = x - step * d
        x[out] = step
        inverse[out] /= d[out]
        d[out] = 0
        inverse -= np.outer(d, inverse[out])
        columns[out] = column
    return list(zip(columns, np.maximum(x, 0), strict=True))


def _take(queue: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The next n pieces of a group, as (length, how many)."""
    out = []
    while n:
        length, left = queue[0]
        k = min(left, n)
        out.append((length, k))
        n -= k
        queue[0][1] -= k
        if not queue[0][1]:
            queue.pop(0)
    return out


def _merged(slots: list[list[tuple[int, int]]], n: int) -> Runs:
    """n sequences with one piece of each slot: runs of sequences that hold the same lengths."""
    ends = sorted({e for s in slots for e in np.cumsum([c for _, c in s]).tolist()})
    out, done = [], 0
    steps = [list(zip(np.cumsum([c for _, c in s]).tolist(), [length for length, _ in s], strict=True)) for s in slots]
    at = [0] * len(slots)
    for e in ends:
        lengths = []
        for i, s in enumerate(steps):
            while s[at[i]][0] <= done:
                at[i] += 1
            lengths.append(s[at[i]][1])
        out.append((tuple(lengths), e - done))
        done = e
    assert done == n
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY, small: int = SMALL, n_groups: int = GROUPS) -> Runs:
    """Runs of equal sequences that hold all pieces; counts[n] pieces have the length n."""
    counts = counts.astype(np.int64).copy()
    out: Runs = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    by_gap: list[Runs] = [[] for _ in range(capacity + 1)]
    left = counts.copy()
    groups = grouped(counts, small, n_groups) if counts[small + 1 :].any() else []
    if groups:
        sizes = np.array([s for s, _ in groups])
        demand = np.array([sum(n for _, n in g) for _, g in groups], float)
        queues = [[list(x) for x in g] for _, g in groups]
        for column, often in configurations(sizes, demand, capacity):
            n = int(often + 1e-6)
            room = [sum(c for _, c in q) // int(a) for q, a in zip(queues, column, strict=True) if a]
            n = min([n, *room])
            if n <= 0:
                continue
            slots = [_take(q, n) for q, a in zip(queues, column, strict=True) for _ in range(int(a))]
            # the smallest of several goes back: what fits the actual gap best is found below
            for lengths, k in _merged(slots[: max(1, len(slots) - 1)], n):
                by_gap[capacity - sum(lengths)].append((lengths, k))
                for length in lengths:
                    left[length] -= k
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            gap = next((g for g in range(length, capacity + 1) if by_gap[g]), None)
            if gap is None:
                lengths, k = (), n
                gap = capacity
            else:
                lengths, k = by_gap[gap].pop()
            each = min(gap // length, n)
            used = min(k, n // each)
            if k > used and lengths:
                by_gap[gap].append((lengths, k - used))
            by_gap[gap - each * length].append((lengths + (length,) * each, used))
            n -= used * each
    return out + [run for runs in by_gap for run in runs]


def slots_of(runs: Runs) -> dict[str, np.ndarray]:
    """For searching: length and first number of each slot's pieces, its first sequence and its place in the sequence."""
    rows, taken, base = [], {}, 0
    for lengths, n in runs:
        at = 0
        for length in lengths:
            first = taken.get(length, 0)
            rows.append((length, first, base, at))
            taken[length] = first + n
            at += length
        base += n
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 48) + a[:, 1], "first": a[:, 1], "base": a[:, 2], "at": a[:, 3]}


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    # `row` tells pieces apart that are equal in all else; once written it stays
    pieces = staged(tokenised(docs, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    sent = spark.sparkContext.broadcast(slots_of(plan(counts, capacity)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sent.value
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            at = np.searchsorted(slots["key"], (length << 48) + number, side="right") - 1
            sequence = slots["base"][at] + number - slots["first"][at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(slots["at"][at])], names=[*columns, "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    by_length = {n: int(counts[n]) for n in np.flatnonzero(counts).tolist()}
    return numbered(pieces, "length", by_length, "row").select(*columns, "number").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
