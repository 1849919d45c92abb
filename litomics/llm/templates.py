"""Benchmark decontamination by template canonicalisation.

Words lose case and outer punctuation; numbers, units after a number and names become typed placeholders. Names are capitalised words,
in one reading only those inside a sentence (CLOSED), in another those that open one as well (OPEN). The windows of both readings are
joined. Windows of WINDOW template words of the benchmark are joined by hash with those of the documents, so a question whose numbers
or names were changed still meets its source. Matches are then lined up: along one alignment of a document with an
item each value of the item must stand for one value of the document. Where it does not, only windows without
placeholders count. A document contains an item if the counting windows of one stretch of it, of about the item's length, cover at least COVER
of the item's windows; windows scattered over a document do not add up.

Windows that are mostly placeholders say nothing and are left out. An item with fewer words than WINDOW is one window. An item with at most
one closed window that says something has its windows of plain words too (PLAIN), numbers and names as they stand, and is contained where all
of these are met, so a verbatim copy of an item is always found.

The benchmark's windows are broadcast while there are at most MOST_WINDOWS of them; a larger benchmark is joined by a shuffle.

Nulls: a null text has no words; an item with a null item_id or no words matches nothing; a document with a null
doc_id is neither reported nor dropped. Repeated rows are reported once. Empty tables give an empty result. No text is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import bound_rows, gram_hashes, places, small_batches, staged, table, text_chunks, without

WINDOW = 8
COVER = 0.5
MOST_WINDOWS = 1_000_000
#: Words that a task remembers; then it starts anew.
MEMO_WORDS = 50_000

NUMBER = re.compile(rb"[+\-]?(?:[$]|\xe2\x82\xac|\xc2\xa3)?[0-9](?:[0-9.,:/]*[0-9])?%?")
NUMBER_WORDS = frozenset(b"two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
UNITS = frozenset(
    b"mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers"
    b" mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml l litre litres liter liters s sec second seconds min minute minutes"
    b" h hr hour hours day days week weeks month months year years c f k kelvin percent dollar dollars euro euros cent cents j kj w kw v a hz khz mhz".split()
)
OUTER = b".,;:!?\"'()[]{}<>*#&%$|_-/\\=+~`"
DIGITS = frozenset(b"0123456789")
LITERAL, NUM, NAME, UNIT = range(4)
CLOSED, OPEN, PLAIN = range(3)
#: Tells windows of plain words from those of templates.
_PLAIN_SALT = np.uint64(0x706C61696E << 16)
_PLACEHOLDER = np.array([0, 0x6E756D, 0x6E616D65, 0x756E6974], np.uint64)


class Canon(dict):
    """Ids of raw words; by id: the hash of the plain word, its kind, whether it may be a unit or a name, whether a sentence ends."""

    def __init__(self) -> None:
        self.new: list[tuple[int, bool, bool, bool, bool]] = []
        self.size, self.hashes, self.flags = 0, np.zeros(1024, np.uint64), np.zeros((1024, 4), bool)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and flags by id."""
        size = self.size + len(self.new)
        if size > len(self.hashes):
            room = max(size, 2 * len(self.hashes)) - self.size
            self.hashes = np.concatenate([self.hashes[: self.size], np.zeros(room, np.uint64)])
            self.flags = np.concatenate([self.flags[: self.size], np.zeros((room, 4), bool)])
        if self.new:
            self.hashes[self.size : size] = [r[0] for r in self.new]
            self.flags[self.size : size] = [r[1:] for r in self.new]
            self.size, self.new = size, []
        return self.hashes, self.flags

    def __missing__(self, raw: bytes) -> int:
        if raw.islower() and raw.isalpha():
            # most words: nothing to strip, no digit, no capital, no end
            row = (xxh3_64_intdigest(raw), raw in NUMBER_WORDS, False, raw in UNITS, False)
        else:
            bare = raw.strip(OUTER)
            word = bare.lower() or raw
            number = word in NUMBER_WORDS or not DIGITS.isdisjoint(bare) and bool(NUMBER.fullmatch(raw.strip(b".,;:!?\"'()[]{}")))
            capital = not number and bare[:1].isupper() and not bare[1:].isupper()
            end = not raw[-1:].isalnum() and raw.rstrip(b"\"')]*")[-1:] in b".!?" and bool(bare)
            row = (xxh3_64_intdigest(word), number, capital, word in UNITS, end)
        self[raw] = i = self.size + len(self.new)
        self.new.append(row)
        return i


class Templates:
    """Template words of a chunk of texts."""

    def __init__(self) -> None:
        self.canon = Canon()

    def __call__(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all plain words, their kinds in the closed and the open reading, and where each text begins."""
        if len(self.canon) > MEMO_WORDS:
            self.canon = Canon()
        counts = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        get = self.canon.__getitem__
        ids = np.fromiter((get(w) for ws in words for w in ws), np.int64, int(starts[-1]))
        if not len(ids):
            return np.zeros(0, np.uint64), ids, ids, starts
        hashes, flags = self.canon.arrays()
        hashes, flags = hashes[ids], flags[ids]
        first = np.zeros(len(ids), bool)
        first[starts[:-1][counts > 0]] = True
        before = np.roll(flags, 1, axis=0)
        rest = np.where(flags[:, 2] & ~first & before[:, 0], UNIT, LITERAL)
        opened = np.where(flags[:, 0], NUM, np.where(flags[:, 1], NAME, rest))
        closed = np.where((opened == NAME) & (first | before[:, 3]), rest, opened)
        return hashes, closed, opened, starts


def _readings(hashes: np.ndarray, closed: np.ndarray, opened: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of template words and their kinds, by reading."""
    return [*((np.where(k == LITERAL, hashes, _PLACEHOLDER[k]), k) for k in (closed, opened)), (hashes, np.zeros(len(hashes), np.int64))]


def _windows(hashes: np.ndarray, kinds: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of windows of n template words that are not mostly placeholders."""
    at = places(starts, n)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    slots = np.concatenate([[0], np.cumsum(kinds != LITERAL)])
    at = at[2 * (slots[at + n] - slots[at]) <= n]
    return at, gram_hashes(hashes, n)[at] ^ np.uint64(n)


def _slots(words: list[bytes], kinds: np.ndarray, at: int, n: int) -> list[str]:
    return [words[k].strip(OUTER).lower().decode("utf-8", "replace") for k in range(at, at + n) if kinds[k] != LITERAL]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words in the window), place, hash, slots, n_windows, reading, words of every item."""
    kind = dict(benchmark.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for part, texts in text_chunks(batches):
            owner, rows = [], []
            for i, t in enumerate(texts):
                words = t.split()
                hashes, closed, opened, starts = templates([words])
                n = min(WINDOW, len(words))
                if not n:
                    continue
                read = _readings(hashes, closed, opened)
                few = 0
                for reading, (h, kinds) in enumerate(read):
                    if reading == PLAIN and few > 1:
                        continue
                    at, h = _windows(h, kinds, starts, n)
                    few = len(at) if reading == CLOSED else few
                    if reading == PLAIN:
                        h = h ^ _PLAIN_SALT
                    for a, x in zip(at, h, strict=True):
                        owner.append(i)
                        rows.append((n, int(a), int(x.view(np.int64)), _slots(words, kinds, a, n), len(at) if reading == PLAIN else few, reading, len(words)))
            kinds_ = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds_, strict=True))], names=["item_id", "n", "item_at", "hash", "item_slots", "n_windows", "reading", "item_words"])

    return benchmark.where("item_id is not null").select("item_id", "text").dropDuplicates().mapInArrow(run, f"item_id {kind}, n int, item_at int, hash long, item_slots array<string>, n_windows int, reading int, item_words int")


def document_windows(docs: DataFrame, lengths: list[int], plain: list[int], wanted: np.ndarray | None) -> DataFrame:
    """doc_id, at, hash, slots of the documents' windows: templates of `lengths`, plain words of `plain`; only of `wanted` (sorted) hashes if given."""
    kind = dict(docs.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, keys = Templates(), sent.value
        if keys is not None:
            # most windows meet no key, which a table of bits tells sooner than a search
            size = np.uint64((1 << max(16, int(16 * len(keys)).bit_length())) - 1)
            maybe = np.zeros(int(size) + 1, bool)
            maybe[keys.view(np.uint64) & size] = True
        for part, texts in text_chunks(batches):
            words = [t.split() for t in texts]
            hashes, closed, opened, starts = templates(words)
            read = _readings(hashes, closed, opened)
            differs = np.concatenate([[0], np.cumsum(closed != opened)])
            owner, rows = [], []
            for reading, n in [*((r, n) for n in lengths for r in (CLOSED, OPEN)), *((PLAIN, n) for n in plain)]:
                h, kinds = read[reading]
                at, h = _windows(h, kinds, starts, n)
                if reading == OPEN:
                    new = differs[at + n] > differs[at]
                    at, h = at[new], h[new]
                elif reading == PLAIN:
                    h = h ^ _PLAIN_SALT
                if keys is not None:
                    some = maybe[h & size]
                    at, h = at[some], h[some].view(np.int64)
                    hit = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
                    at, h = at[hit], h[hit]
                h = h.view(np.int64)
                own = np.searchsorted(starts, at, side="right") - 1
                for a, x, i in zip(at.tolist(), h.tolist(), own.tolist(), strict=True):
                    s = int(starts[i])
                    owner.append(i)
                    rows.append((a - s, x, _slots(words[i], kinds[s : starts[i + 1]], a - s, n)))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds_ = (pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds_, strict=True))], names=["doc_id", "at", "hash", "slots"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, at int, hash long, slots array<string>")


def contained_items(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_changed (values that differ) of every document that contains an item."""
    small_batches(docs.sparkSession)
    bench = staged(benchmark_windows(benchmark), "benchmark")
    pairs = [(r["n"], r["reading"]) for r in bench.select("n", "reading").distinct().collect()]  # at most 3 * WINDOW
    lengths, plain = sorted({n for n, r in pairs if r != PLAIN}), sorted({n for n, r in pairs if r == PLAIN})
    wanted, side = None, bench
    if bound_rows(bench, MOST_WINDOWS) is not None:
        wanted = np.array(sorted({r["hash"] for r in bench.select("hash").collect()}), np.int64)
        side = F.broadcast(bench)
    if not pairs:
        lengths, wanted = [WINDOW], np.zeros(1, np.int64)
    met = staged(document_windows(docs, lengths, plain, wanted).join(side, "hash").withColumn("line", F.col("at") - F.col("item_at")), "met")

    line = ["doc_id", "item_id", "reading", "line"]
    values = met.select(*line, F.explode(F.arrays_zip("item_slots", "slots")).alias("v")).select(*line, F.col("v.item_slots").alias("was"), F.col("v.slots").alias("now"))
    stands_for = values.groupBy(*line, "was").agg(F.min("now").alias("low"), F.max("now").alias("high"))
    lines = stands_for.groupBy(*line).agg(F.bool_or(F.col("low") != F.col("high")).alias("torn"), F.count_if(F.col("low") != F.col("was")).alias("changed"))
    counted = met.join(lines, line, "left").where(~F.coalesce("torn", F.lit(False)) | (F.size("slots") == 0))
    # both readings of a template count together; plain windows count by themselves, and all of them have to be met
    exact = F.col("reading") == PLAIN
    # two rows of stretches, twice an item's length each, the second shifted by half: lines that lie less than an item's length apart share one
    place = F.col("line") / (2 * F.col("item_words"))
    stretch = F.explode(F.array(2 * F.floor(place), 2 * F.floor(place + 0.5) + 1))
    return (
        counted.select("*", exact.alias("exact"), stretch.alias("stretch")).groupBy("doc_id", "item_id", "exact", "stretch")
        .agg(F.max("n_windows").alias("n_windows"), F.countDistinct("item_at").alias("n_matched"), F.coalesce(F.max("changed"), F.lit(0)).alias("n_changed"))
        .where(F.col("n_matched") >= F.when(F.col("exact"), F.col("n_windows")).otherwise(cover * F.col("n_windows")))
        .groupBy("doc_id", "item_id")
        .agg(F.min(F.struct("exact", -F.col("n_matched"), "n_windows", "n_matched", "n_changed")).alias("m"))
        .select("doc_id", "item_id", "m.n_windows", "m.n_matched", "m.n_changed")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that contain no item."""
    return without(docs, staged(contained_items(docs, benchmark).select("doc_id").distinct(), "gone"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
