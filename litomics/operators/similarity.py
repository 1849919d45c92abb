"""Similarity of short texts by longest matching blocks: bounds as expressions first, then blocks of many pairs at once in arrays.

The ratio of two texts is twice the characters in matching blocks over all their characters. The blocks are the longest common run (the first in the first text, then the first in the second), and
the same again left and right of it."""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that the search for common runs holds at once: pairs by characters of their second texts.
CELLS = 2_000_000
#: Pairs whose common letters are counted at once: few, so that they stay in the processor's cache.
PAIRS = 32_000
#: Pairs whose bounds are held at once.
HELD = 100_000
#: Sets of places that are kept, by what texts begin and end with.
KEPT_PLACES = 8
#: Texts that are worth blocks, letters in which those of a block differ at most, and texts of a block that are worth it, on average.
LEAST_TEXTS, MOST_OTHER, BLOCK = 512, 4, 24
#: Texts that are held against all blocks in one go.
ROWS = 4_096
#: Bytes of a batch of groups that comes to a task, beside its last group.
BATCH_BYTES = 4 << 20


def length_bound(a: Column, b: Column) -> Column:
    """No ratio is higher: all of the shorter text matches."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / F.nullif(both, F.lit(0)))


def letter_bound(a: Column, b: Column) -> Column:
    """No ratio is higher: every character matches as often as both texts have it, whatever the order."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * shared / F.nullif(both, F.lit(0)))


def candidates(pairs: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """Pairs that the bounds do not rule out; the cheap bound is asked first. Rounding is given its share, so that no pair at the threshold is lost."""
    least = threshold - 1e-9
    return pairs.where(length_bound(F.col(a), F.col(b)) >= least).where(letter_bound(F.col(a), F.col(b)) >= least)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of texts as rows, -1 behind their ends; and their lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(lengths.max(initial=0))), -1, np.int32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    return out, lengths


def _longest_runs(a: np.ndarray, b: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each box (pair, from and to in a, from and to in b) the longest common run: where it begins in a and b, and its length."""
    pair, a0, a1, b0, b1 = box.T
    n, width = len(box), int((b1 - b0).max(initial=0))
    column = np.arange(width)
    chars = b[pair[:, None], np.minimum(b0[:, None] + column, b.shape[1] - 1)]
    chars[column >= (b1 - b0)[:, None]] = -2
    run = np.zeros((n, width + 1), np.int32)
    size, at_a, at_b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for step in range(int((a1 - a0).max(initial=0))):
        inside = a0 + step < a1
        own = a[pair, np.minimum(a0 + step, a.shape[1] - 1)]
        run[:, 1:] = np.where((chars == own[:, None]) & inside[:, None], run[:, :-1] + 1, 0)
        end = run[:, 1:].argmax(axis=1)
        best = run[np.arange(n), end + 1]
        better = best > size
        size[better], at_a[better], at_b[better] = best[better], (a0 + step - best + 1)[better], (b0 + end - best + 1)[better]
    return at_a, at_b, size


def matching_characters(first: list[str], second: list[str]) -> np.ndarray:
    """Characters in matching blocks of each pair of texts."""
    out = np.zeros(len(first), np.int64)
    if not first:
        return out
    (a, n_a), (b, n_b) = _codes(first), _codes(second)
    if not a.shape[1] or not b.shape[1]:
        return out
    boxes = np.stack([np.arange(len(first)), np.zeros_like(n_a), n_a, np.zeros_like(n_b), n_b], axis=1)
    boxes = boxes[(n_a > 0) & (n_b > 0)]
    while len(boxes):
        some, boxes = boxes[: max(1, CELLS // b.shape[1])], boxes[max(1, CELLS // b.shape[1]) :]
        at_a, at_b, size = _longest_runs(a, b, some)
        np.add.at(out, some[:, 0], size)
        met = size > 0
        pair, a0, a1, b0, b1 = some[met].T
        i, j, k = at_a[met], at_b[met], size[met]
        sides = np.concatenate([np.stack([pair, a0, i, b0, j], axis=1), np.stack([pair, i + k, a1, j + k, b1], axis=1)])
        boxes = np.concatenate([boxes, sides[(sides[:, 1] < sides[:, 2]) & (sides[:, 3] < sides[:, 4])]])
    return out


def ratios(first: list[str], second: list[str]) -> np.ndarray:
    both = np.array([len(x) + len(y) for x, y in zip(first, second, strict=True)], float)
    return np.where(both == 0, 1.0, 2 * matching_characters(first, second) / np.where(both == 0, 1, both))


def with_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the ratio of their texts (no nulls), worked out for a batch of pairs of like length at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(a).to_pylist(), batch.column(b).to_pylist()
            out = np.empty(len(x))
            order = sorted(range(len(x)), key=lambda k: len(x[k]) + len(y[k]))
            for at in range(0, len(x), 512):
                some = order[at : at + 512]
                out[some] = ratios([x[k] for k in some], [y[k] for k in some])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "ratio"])

    schema = ", ".join(f"`{c}` {k}" for c, k in pairs.dtypes)
    return pairs.mapInArrow(run, f"{schema}, ratio double")


class Texts(NamedTuple):
    """Characters of texts as rows, from their beginnings and from their ends, -1 behind; and their lengths."""

    codes: np.ndarray
    back: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Texts:
        codes, lengths = _codes(texts)
        at = lengths[:, None] - 1 - np.arange(codes.shape[1])
        return Texts(codes, np.where(at >= 0, np.take_along_axis(codes, np.maximum(at, 0), axis=1), -1), lengths)

    def take(self, rows: np.ndarray) -> Texts:
        width = int(self.lengths[rows].max(initial=0))
        return Texts(self.codes[rows, :width], self.back[rows, :width], self.lengths[rows])

    def within(self, head: int, tail: int) -> np.ndarray:
        """The characters but for `head` at the beginning and `tail` at the end."""
        left = self.lengths - head - tail
        some = self.codes[:, head : head + int(left.max(initial=0))]
        return np.where(np.arange(some.shape[1]) < left[:, None], some, -1)


def _leading(equal: np.ndarray) -> int:
    """Columns up to the first that is not true everywhere."""
    every = equal.all(axis=0)
    return len(every) if every.all() else int(every.argmin())


class Letters:
    """Texts that others are held against by their common letters. What all texts of both sides begin and end with is common and counted once for all; the rest is searched."""

    def __init__(self, texts: Texts) -> None:
        self.texts, self.least = texts, int(texts.lengths.min())
        self.head, self.tail = (side[0, : _leading(side[:, : self.least] == side[0, : self.least])] for side in (texts.codes, texts.back))
        self.places: dict[tuple[int, int], tuple] = {}

    def _places(self, head: int, tail: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The letters of the texts without beginning and end, and for each part of at most 64 letters a bit for each place of a letter in each text, and the bits that a text has."""
        if (head, tail) not in self.places:
            if len(self.places) >= KEPT_PLACES:
                self.places.clear()
            b, n_b = self.texts.within(head, tail), self.texts.lengths - head - tail
            letters, parts = np.unique(b[b >= 0]), []
            at = np.searchsorted(letters, b)
            for start in range(0, b.shape[1], 64):
                width = min(64, b.shape[1] - start)
                bits = next(k for k in (np.uint16, np.uint32, np.uint64) if width <= 8 * k().itemsize)
                # the last row is of letters that no text has
                places = np.zeros((len(letters) + 1, len(b)), bits)
                for k in range(width):
                    own = np.flatnonzero(b[:, start + k] >= 0)
                    places[at[own, start + k], own] |= bits(1 << k)
                inside = np.array([(1 << k) - 1 for k in range(width + 1)], bits)[np.clip(n_b - start, 0, width)]
                parts.append((places, inside))
            self.places[head, tail] = letters, parts
        return self.places[head, tail]

    def common(self, first: Texts) -> np.ndarray:
        """For each pair of a text of `first` and one of these, letters of their longest common sequence; a little more where the latter is longer than 64. Matching blocks never have more.

        A bit for each letter of these texts; a letter of the first moves on all of them at once. Longer ones are counted in parts, and the parts summed."""
        shortest = int(first.lengths.min())
        head, tail = (_leading(side[:, : min(len(own), shortest)] == own[:shortest]) for side, own in ((first.codes, self.head), (first.back, self.tail)))
        tail = min(tail, min(shortest, self.least) - head)
        letters, parts = self._places(head, tail)
        a = first.within(head, tail)
        at = np.minimum(np.searchsorted(letters, a), max(0, len(letters) - 1))
        # -1 stands behind ends, and letters that none of these texts has are nothing either
        code = np.where((a >= 0) & (letters[at] == a), at, len(letters)) if len(letters) else np.zeros(a.shape, np.int64)
        n = len(self.texts.lengths)
        out = np.full((len(a), n), head + tail, np.int32)
        step = max(1, PAIRS // n)
        for places, inside in parts:
            for k in range(0, len(a), step):
                some = code[k : k + step]
                open_ = np.full((len(some), n), ~places.dtype.type(0), places.dtype)
                for c in some.T[(some != len(letters)).any(axis=0)]:
                    met = places[c]
                    met &= open_
                    moved = open_ + met
                    open_ -= met
                    open_ |= moved
                out[k : k + step] += np.bitwise_count(~open_ & inside)
        return out


def _blocks(texts: list[str]) -> tuple[list[np.ndarray], list[str], np.ndarray]:
    """Blocks of texts that are equal but for a few letters in one place before their common end: their numbers, what they have in common, and the most letters that one has besides. One block of all where there are no such."""
    tail = len(commonprefix([min(back := [t[::-1] for t in texts]), max(back)]))
    for few in range(1, MOST_OTHER + 1) if len(texts) >= LEAST_TEXTS else ():
        found: dict[str, list[int]] = {}
        for k, t in enumerate(texts):
            found.setdefault(t[: max(0, len(t) - tail - few)], []).append(k)
        if len(found) * BLOCK <= len(texts):
            end = texts[0][len(texts[0]) - tail :]
            return [np.array(own) for own in found.values()], [head + end for head in found], np.full(len(found), few)
    return [np.arange(len(texts))], [""], np.array([max(map(len, texts))])


def best_of(first: list[str], second: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text of `first` the number of the most similar one of `second`, the first of equally similar ones, and its ratio; -1 where none reaches the threshold.

    A text is held against one that by its letters can be most similar, and then only against those that can be better than that, or as good and come before it. These are taken by the most
    that their ratio can be, until none that is left can be better than the best so far. What texts of `second` have in common bounds them all: a letter more adds one common letter at most."""
    best, ratio = np.full(len(first), -1, np.int64), np.full(len(first), threshold, float)
    if not first or not second:
        return best, np.full(len(first), np.nan)
    texts, held_texts = Texts.of(first), Texts.of(second)
    n_a, n_b = texts.lengths, held_texts.lengths
    blocks, shared, others = _blocks(second)
    own, least = [None] * len(blocks), np.array([n_b[members].min() for members in blocks])
    outline = Letters(Texts.of(shared))

    def bounds(rows: np.ndarray, letters: Letters, lengths: np.ndarray, more: np.ndarray | int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, HELD // len(lengths))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            common, both = letters.common(texts.take(some)) + more, np.add.outer(n_a[some], lengths, dtype=float)
            common *= 2
            if n_a[some].min() + lengths.min() == 0:
                none = both == 0
                common[none] = both[none] = 1
            yield some, np.divide(common, both, out=both)

    def within(rows: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if own[block] is None:
            own[block] = Letters(held_texts.take(blocks[block]))
        return bounds(rows, own[block], n_b[blocks[block]])

    # texts that end alike are neighbours
    rows, top = np.array(sorted(range(len(first)), key=lambda k: first[k][::-1])), np.full(len(first), -1, np.int64)
    nearest = np.full(len(first), -1, np.int64)
    for some, bound in bounds(rows, outline, least, others):
        block = bound.argmax(axis=1)
        nearest[some] = np.where(bound[np.arange(len(some)), block] >= threshold, block, -1)
    rows = rows[nearest[rows] >= 0]
    for block, mine in _dealt(nearest[rows], rows):
        for some, bound in within(mine, block):
            column = bound.argmax(axis=1)
            top[some] = np.where(bound[np.arange(len(some)), column] >= threshold, blocks[block][column], -1)
    held = rows[top[rows] >= 0]
    _judge(first, second, held, top[held], best, ratio)

    left, n = [], 0
    for at in range(0, len(rows), ROWS):
        near = [np.nonzero(bound >= ratio[some][:, None]) + (some,) for some, bound in bounds(rows[at : at + ROWS], outline, least, others)]
        for block, mine in _dealt(np.concatenate([k for _, k, _ in near]), np.concatenate([some[r] for r, _, some in near])):
            members = blocks[block]
            for some, bound in within(mine, block):
                now, held = ratio[some][:, None], best[some][:, None]
                row, column = np.nonzero((bound > now) | ((bound == now) & ((held < 0) | (members < held))))
                new = top[some[row]] != members[column]
                left.append((some[row][new], members[column][new], bound[row, column][new]))
                n += len(left[-1][0])
                if n >= HELD:
                    _search(first, second, *map(np.concatenate, zip(*left, strict=True)), best, ratio)
                    left, n = [], 0
    if n:
        _search(first, second, *map(np.concatenate, zip(*left, strict=True)), best, ratio)
    return best, np.where(best < 0, np.nan, ratio)


def _dealt(keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with its rows, in their order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    for key, some in zip(found.tolist(), np.split(rows[order], starts[1:]), strict=True):
        yield key, some


def _search(first: list[str], second: list[str], row: np.ndarray, column: np.ndarray, can: np.ndarray, best: np.ndarray, ratio: np.ndarray) -> None:
    """Judges pairs of whole rows by the most that their ratio can be, until those that are left can be no better than the best of their row."""
    order = np.lexsort((column, -can, row))
    row, column, can = row[order], column[order], can[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    at, size = 0, 1
    while len(row):
        now, held = ratio[row], best[row]
        open_ = (can > now) | ((can == now) & ((held < 0) | (column < held)))
        row, column, can, place = row[open_], column[open_], can[open_], place[open_]
        turn = place < at + size
        _judge(first, second, row[turn], column[turn], best, ratio)
        row, column, can, place = row[~turn], column[~turn], can[~turn], place[~turn]
        at, size = at + size, 2 * size


def _judge(first: list[str], second: list[str], row: np.ndarray, column: np.ndarray, best: np.ndarray, ratio: np.ndarray) -> None:
    """Puts the exact ratios of pairs into `best` and `ratio`."""
    found = np.empty(len(row))
    # pairs of like length meet, so that short ones don't wait for a long one
    size = np.array([len(first[i]) + len(second[j]) for i, j in zip(row.tolist(), column.tolist(), strict=True)], np.int64)
    order = np.argsort(size, kind="stable")
    for at in range(0, len(row), 2048):
        some = order[at : at + 2048]
        found[some] = ratios([first[i] for i in row[some]], [second[j] for j in column[some]])
    for i, j, r in zip(row.tolist(), column.tolist(), found.tolist(), strict=True):
        if r > ratio[i] or (r == ratio[i] and (best[i] < 0 or j < best[i])):
            best[i], ratio[i] = j, r


def with_best(groups: DataFrame, threshold: float) -> DataFrame:
    """(term, axis, n, name, ratio) of the most similar name of each term in its group. groups: axis, terms (array of term, q), names (array of n, name in order of preference)."""
    groups.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in range(batch.num_rows):
                axis, terms, names = (batch.column(c)[group] for c in ("axis", "terms", "names"))
                terms, names = terms.values, names.values
                best, ratio = best_of(terms.field("q").to_pylist(), names.field("n").to_pylist(), threshold)
                hit = np.flatnonzero(best >= 0)
                if len(hit):
                    columns = [terms.field("term").take(pa.array(hit)), pa.array([axis.as_py()] * len(hit), pa.string()), *(names.field(f).take(pa.array(best[hit])) for f in ("n", "name")), pa.array(ratio[hit])]
                    yield pa.RecordBatch.from_arrays(columns, ["term", "axis", "n", "name", "ratio"])

    return groups.select("axis", "terms", "names").mapInArrow(run, "term string, axis string, n string, name string, ratio double")
