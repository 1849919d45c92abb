"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One permutation sigma scatters a document's shingles; a second one, pi, shifted circularly by k, gives coordinate k of the
signature: min pi(sigma(x) + k). ROWS coordinates make a band. At a similarity of 0.8 a pair shares no band with
probability (1 - 0.8^ROWS)^BANDS, about 1e-7.

Equal sets are one representative from the start. Candidates of a band are never expanded into all pairs:
1. Each member is verified against its band's least member (a star); links merge into components.
2. A pair in one component needs no look. Documents of bands that still hold several components are compared across
   components by their rarest shingles, as counted among these documents: in one order of all shingles, rare ones first, two sets of sizes
   n >= m that are similar enough share one among the first n - 0.8 n + 1 of the larger and the first m - 2 * 0.8 / 1.8 m + 1 of the smaller
   one. Shingles that one document alone has take places but are never joined. At a shingle, documents outside its largest component
   meet those of other components; what a common shingle would bring together has no place among these first ones but where texts have little else.
Both steps verify on full sets of 64-bit shingles. No bucket or candidate list has a cap.

Groups of equal sets can be large: the rows of those that hold a noticeable part of all rows meet their representative by a broadcast of fewer
than 1 / HOT rows, the rest by a shuffle.

Nulls: a null or empty text has no shingles and is linked with nothing. A null doc_id is linked with nothing and has a null
component. Rows that share a doc_id are one node. Repeated rows stay. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from .common import discard, gram_hashes, looked_up, mix, small_batches, staged, table, text_chunks, within, without, word_hashes
from .components import roots

ROWS, BANDS = 5, 40
SIMILARITY = 80  # per cent
WORDS = 5  # of a shingle
BLOCK = 2048
LOWER = bytes((c + 32 if 65 <= c <= 90 else c) for c in range(256))


def mix32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n coordinates from two permutations."""
    sigma = mix32(shingles.astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    shifts = np.arange(n, dtype=np.uint32)[:, None]
    best = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), BLOCK):
        np.minimum(best, mix32(sigma[None, at : at + BLOCK] + shifts, 0x7FEB352D, 0x846CA68B).min(axis=1), out=best)
    return best


def bands(shingles: np.ndarray, rows: int = ROWS, n_bands: int = BANDS) -> np.ndarray:
    """One key for each band; keys of different bands differ."""
    s = signature(shingles, rows * n_bands).reshape(n_bands, rows).astype(np.uint64)
    key = np.arange(n_bands, dtype=np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, k])
    return key


def shingle_sets(texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, int]]:
    """Sorted distinct n-word shingles of each text; with fewer words, the whole sequence as one; and the number of words."""
    hashes, starts = word_hashes([t.translate(LOWER).split() for t in texts])
    for i in range(len(texts)):
        h = hashes[starts[i] : starts[i + 1]]
        if len(h) == 0:
            yield h, 0
        else:
            yield np.unique(gram_hashes(h, min(n, len(h)))), len(h)


def signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, and the keys of its bands."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            size, one, two, keys = [], [], [], []
            for s, _ in shingle_sets(texts, n):
                h = xxh3_128_intdigest(s.tobytes())
                size.append(len(s))
                one.append(h & (2**63 - 1))
                two.append(h >> 65)
                keys.append(bands(s).view(np.int64) if len(s) else [])
            columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, one, two)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, h1 long, h2 long, bands array<long>")


def packed_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and its sorted shingles, 8 bytes each."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            sets = [s.astype("<u8").tobytes() for s, _ in shingle_sets(texts, n)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, shingles binary")


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with `inter` and `whole`, the sizes of intersection and union of their full sets."""
    kind = dict(pairs.dtypes)["a"]
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            inter, whole = [], []
            for sa, sb in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                if sa != last:
                    last, mine = sa, unpacked(sa)
                other = unpacked(sb)
                at = np.searchsorted(mine, other)
                same = int((mine[np.minimum(at, len(mine) - 1)] == other).sum())
                inter.append(same)
                whole.append(len(mine) + len(other) - same)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter, pa.int64()), pa.array(whole, pa.int64())], names=["a", "b", "inter", "whole"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}, inter long, whole long")


def exploded(rows: DataFrame) -> DataFrame:
    """token, doc_id, comp, n for each shingle of each set."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("shingles").to_pylist()
            sizes = np.array([len(x) // 8 for x in raw], np.int64)
            token = unpacked(b"".join(raw)).view(np.int64)
            at = pa.array(np.repeat(np.arange(len(raw)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(token), batch.column("doc_id").take(at), batch.column("comp").take(at), pa.array(np.repeat(sizes, sizes))], names=["token", "doc_id", "comp", "n"])

    return rows.select("doc_id", "comp", "shingles").mapInArrow(run, f"token long, doc_id {kind}, comp {kind}, n long")


def rare_prefixes(rows: DataFrame, similarity: int) -> DataFrame:
    """token, place (from 0), doc_id, comp, n of the first shingles of each set, in an order of all shingles with rare ones first.

    Counts are exact. A shingle of one document takes its place but is not returned; documents of one component need no look at each other,
    so a shingle that all its documents' one component has is not returned either."""
    tokens = staged(exploded(rows), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("often"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("often > 1")
    met = tokens.join(often, "token").select("doc_id", "comp", "n", F.struct("often", "token", (F.col("low") < F.col("high")).alias("apart")).alias("t"))
    # a document's own shingles, as many as its text has
    by_doc = met.groupBy("doc_id", "comp", "n").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    alone = F.col("n") - F.size("ts")
    most = F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1
    placed = by_doc.select("doc_id", "comp", "n", alone.alias("alone"), F.posexplode(F.slice("ts", F.lit(1), F.greatest(F.lit(0), most - alone).cast("int"))).alias("i", "t"))
    return placed.where("t.apart").select(F.col("t.token").alias("token"), (F.col("i") + F.col("alone")).alias("place"), "doc_id", "comp", "n")


def classes(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`."""
    small_batches(docs.sparkSession)
    every = staged(signed(docs, words), "signed")
    some = every.where("n_shingles > 0 and doc_id is not null")
    total = some.count()
    first = staged(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "first")
    as_rep = looked_up(some.select("doc_id", "n_shingles", "h1", "h2", "bands"), first, ["h1", "h2"], "copies", total)
    reps = as_rep.where("doc_id = rep").select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    shared = reps.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last").select("band", "pivot")
    members = staged(reps.join(shared, "band").select("band", "pivot", F.col("doc_id").alias("b"), "n_shingles").distinct(), "members")
    named = staged(members.select(F.col("b").alias("doc_id")).distinct(), "named")
    sets = staged(packed_sets(within(docs.select("doc_id", "text"), named).dropDuplicates(["doc_id"]), words), "sets")

    star = members.where("b <> pivot").select(F.col("pivot").alias("a"), "b").distinct()
    seen = staged(overlaps(star, sets), "seen")
    is_link = F.col("inter") * 100 >= F.col("whole") * similarity
    found = staged(roots(seen.where(is_link).select("a", "b")), "roots")

    # documents of bands that hold several components
    placed = members.join(found.select(F.col("node").alias("b"), "root"), "b", "left").withColumn("comp", F.coalesce("root", "b")).drop("root")
    mixed = placed.groupBy("band").agg((F.min("comp") < F.max("comp")).alias("mixed")).where("mixed").select("band")
    open_ = placed.join(mixed, "band").select(F.col("b").alias("doc_id"), "comp").distinct().join(sets, "doc_id")
    prefixes = staged(rare_prefixes(open_, similarity), "prefixes")
    discard(members, named, seen)
    main = prefixes.groupBy("token", "comp").count().groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("n_comps")).where("n_comps > 1").drop("n_comps")
    told = prefixes.join(main, "token")
    # the smaller one of two sets shares a shingle among still fewer of its first ones
    small = F.col("n") - F.ceil(F.lit(2 * similarity) * F.col("n") / (100 + similarity))
    told = told.withColumn("is_short", F.col("place") <= small)
    outside = told.where("comp <> main").select("token", F.col("doc_id").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("is_short").alias("sx"))
    inside = told.select("token", F.col("doc_id").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("place").alias("py"), F.col("is_short").alias("sy"))
    # shingles that both must share to be similar enough
    need = F.ceil(similarity * (F.col("nx") + F.col("ny")) / (100 + similarity))
    near = lambda x, y: x.join(y, "token").where((F.col("cx") != F.col("cy")) & (F.col("px") <= F.col("nx") - need) & (F.col("py") <= F.col("ny") - need))
    pairs = (
        near(outside.where("sx"), inside).where("nx <= ny").union(near(outside, inside.where("sy")).where("nx > ny").select("token", "x", "cx", "nx", "px", "sx", "y", "cy", "ny", "py", "sy"))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    )
    more = overlaps(pairs, sets).where(is_link).select("a", "b")
    links = found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
    final = roots(links).select(F.col("node").alias("rep"), "root")
    homes = staged(first.join(final, "rep", "left").select("h1", "h2", "copies", F.coalesce("root", "rep").alias("component_id")), "homes")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    by_set = looked_up(some.select("doc_id", "n_shingles", "h1", "h2"), homes, ["h1", "h2"], "copies", total).select("doc_id", "n_shingles", "component_id", kept)
    alone = every.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return by_set.union(alone)


def keep_one(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One row of `docs` for each class, that with the least doc_id; of rows that share it, one. Rows without doc_id stay."""
    every = staged(classes(docs, words, similarity), "classes")
    gone = staged(every.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    stay = without(docs, gone)
    twice = every.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return stay
    return stay.join(twice, "doc_id", "left_anti").union(stay.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), words=2)
