"""Exact dedup by sorting content: sampled splitters deal ranges of bytes to tasks, an external sort places equal texts side by side, neighbours are compared whole.

Before the shuffle each task joins the equal texts that it holds, HELD_BYTES of them at a time, into one row with their number and their largest doc_id, so a text that a third
of all rows have crosses it a few times for each task. Ranges are those of the first PREFIX bytes and then of a 64-bit hash of the whole text: a beginning that many
different texts share is cut by the hash, and equal texts always meet. Spark samples the splitters from these short keys (a million keys at most), never from texts.
The sort is by (beginning, hash, bytes), so only full comparisons of neighbours decide which texts are equal. What goes on from there is a row for each text that occurs twice or more.

Defined cases: a null text is empty, and equals other empty texts. Texts are compared as their bytes, without any change, whatever their length. A null doc_id is smaller than
all others; if all of a group are null, keep_id is null. If several rows of a group have the largest doc_id (repeated rows), exactly one of them is kept. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, LISTED, looked_up, marked, small_batches, staged, table

#: Bytes of a text's beginning by which ranges are cut first.
PREFIX = 64
#: Bytes of different texts that a task holds before it hands them on.
HELD_BYTES = 32_000_000
#: Bytes of an Arrow batch that a task hands on; one longer text is a batch of its own.
OUT_BYTES = 4_000_000

JOINED = "content binary, n long, keep_id long, n_keep long"
GROUPS = "text_sha256 string, keep_id long, group_size long, n_keep long"


def merged(a: tuple[int, int | None, int], b: tuple[int, int | None, int]) -> tuple[int, int | None, int]:
    """Two (rows, largest doc_id, rows that have it) of one text as one; null is smaller than all."""
    if a[1] == b[1]:
        return a[0] + b[0], a[1], a[2] + b[2]
    best = a if b[1] is None or a[1] is not None and a[1] > b[1] else b
    return a[0] + b[0], best[1], best[2]


def handed_on(held: dict[bytes, tuple[int, int | None, int]]) -> Iterator[pa.RecordBatch]:
    """The texts that a task holds, in batches of bounded bytes."""
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = zip(*((text, *held[text]) for text in rows), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["content", "n", "keep_id", "n_keep"])

    for text in held:
        if rows and size + len(text) > OUT_BYTES:
            yield batch()
            rows, size = [], 0
        rows.append(text)
        size += len(text)
    if rows:
        yield batch()


def joined_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of a task, as far as HELD_BYTES reach."""
    held: dict[bytes, tuple[int, int | None, int]] = {}
    size = 0
    for batch in batches:
        for text, doc in zip(batch.column("content").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
            if text in held:
                held[text] = merged(held[text], (1, doc, 1))
                continue
            held[text] = (1, doc, 1)
            size += len(text) + 200
            if size > HELD_BYTES:
                yield from handed_on(held)
                held, size = {}, 0
    yield from handed_on(held)


def equal_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text that two or more documents have; the texts arrive sorted."""
    last, group = None, (0, None, 0)
    for batch in batches:
        found = []
        for text, *more in zip(*(batch.column(c).to_pylist() for c in ("content", "n", "keep_id", "n_keep")), strict=True):
            if text == last:
                group = merged(group, tuple(more))
                continue
            if group[0] > 1:
                found.append((last, group))
            last, group = text, tuple(more)
        yield told(found)
    if group[0] > 1:
        yield told([(last, group)])


def told(found: list[tuple[bytes, tuple[int, int | None, int]]]) -> pa.RecordBatch:
    digests = pa.array([hashlib.sha256(text).hexdigest() for text, _ in found], pa.string())
    n, keep, n_keep = (pa.array([g[k] for _, g in found], pa.int64()) for k in range(3))
    return pa.RecordBatch.from_arrays([digests, keep, n, n_keep], ["text_sha256", "keep_id", "group_size", "n_keep"])


def groups(docs: DataFrame) -> DataFrame:
    """text_sha256, keep_id, group_size and n_keep (rows that have keep_id) of every text of two rows or more."""
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content")
    keyed = docs.select("doc_id", content).mapInArrow(joined_in_task, JOINED).withColumns({"start": F.substring("content", 1, PREFIX), "hash": F.xxhash64("content")})
    ranged = keyed.repartitionByRange("start", "hash").sortWithinPartitions("start", "hash", "content")
    return ranged.select("content", "n", "keep_id", "n_keep").mapInArrow(equal_neighbours, GROUPS)


def first_rows(rows: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """Of texts whose largest doc_id several rows have, the row that stays."""
    held = looked_up(rows, repeated.select("text_sha256", "keep_id", "group_size"), ["text_sha256"], "group_size", total)
    return held.where("doc_id <=> keep_id").groupBy("text_sha256").agg(F.min("row").alias("first_row"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of `docs`. Rows of texts that occur once never move."""
    small_batches(docs.sparkSession)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256")
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest, F.monotonically_increasing_id().alias("row")), "digests")
    found = staged(groups(docs), "groups")
    total = rows.count()
    first = F.lit(None).cast("long").alias("first_row")
    if found.where("n_keep > 1").limit(1).count():
        found = staged(found.join(first_rows(rows, found.where("n_keep > 1"), total), "text_sha256", "left"), "groups")
    else:
        found = found.select("*", first)
    every = marked(rows, found, "text_sha256")
    hot = F.col("group_size") > total * HOT
    doubtful = every.where(LISTED).drop(LISTED).join(F.broadcast(found.where(hot)), "text_sha256", "left")
    columns = [*rows.columns, "keep_id", "group_size", "n_keep", "first_row"]
    near = doubtful.where("group_size is not null").select(columns)
    far = doubtful.where("group_size is null").select(rows.columns).join(found.where(~hot), "text_sha256", "left").select(columns)
    alone = every.where(~F.col(LISTED)).select(*rows.columns, F.lit(None).cast("long").alias("keep_id"), *(F.lit(None).cast("long").alias(c) for c in columns[-3:]))
    return near.union(far).union(alone).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), True).when(F.col("n_keep") == 1, F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.col("row") == F.col("first_row")).alias("kept"),
        "text_sha256",
    )


def op13_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
