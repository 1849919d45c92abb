"""Helpers that the operators of this subpackage share: staging, text batches, word hashes."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

#: Bytes of text that one numpy pass inside a task takes at once; a longer document is a pass of its own.
CHUNK_BYTES = 1_000_000
#: Rows of an Arrow batch. Documents can be very long, so batches stay short.
BATCH_ROWS = 256
#: Bytes of an Arrow batch; one longer document is a batch of its own.
BATCH_BYTES = 4_000_000
#: Bits of the filter that spares documents a shuffle. Its size is fixed; a full filter spares none and loses none.
FILTER_BITS = 1 << 24
LISTED = "_lt_listed"
#: A key with more than this part of all rows is hot; there are fewer than 1 / HOT of them, which bounds what is broadcast.
HOT = 1 / 4096
#: Rows that one task numbers.
BUCKET_ROWS = 200_000

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of document operators short, in rows and bytes. A frame runs later than it is made, so the settings stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set and all runs on this machine, as in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: staged tables need a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="litomics-")
        root = _own_dirs[app]
    return root.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here and every executor sees it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/litomics/{uuid.uuid4().hex}-{label}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove staged frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of a batch that hold about `most` bytes each."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Sub-batches with their texts, bounded in bytes."""
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for part in chunks([len(t) for t in texts]):
            yield batch.slice(part.start, part.stop - part.start), texts[part]


def word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all documents in a row, and where each document begins (one more at the end)."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    return hashes, np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    size = max(0, len(hashes) - n + 1)
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + size]
    return mix(out)


def places(starts: np.ndarray, n: int) -> np.ndarray:
    """Places of the row of words at which n words of one document begin."""
    total = int(starts[-1])
    if total < n:
        return np.zeros(0, np.int64)
    ok = np.zeros(total + 1, np.int32)
    lengths = np.diff(starts)
    long = lengths >= n
    np.add.at(ok, starts[:-1][long], 1)
    np.add.at(ok, starts[1:][long] - n + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def marked(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """`rows` with LISTED: true for every key in `ids`, and for few others while the filter is not full.

    The filter is FILTER_BITS bits, FILTER_BITS / 64 rows of 16 bytes at most, whatever the number of ids; it is broadcast."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = ids.select(bit.alias("_lt_bit")).groupBy(F.floor(F.col("_lt_bit") / 64).alias("_lt_word"))
    bits = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(_lt_bit % 64 as int))")).alias("_lt_bits"))
    found = rows.withColumn("_lt_bit", bit).join(F.broadcast(bits), F.floor(F.col("_lt_bit") / 64) == F.col("_lt_word"), "left")
    listed = F.expr("coalesce((shiftrightunsigned(_lt_bits, cast(_lt_bit % 64 as int)) & 1L) = 1L, false)")
    return found.withColumn(LISTED, listed).select(*rows.columns, LISTED)


def within(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is in `ids`; rows that a filter of fixed size rules out are not shuffled."""
    return marked(rows, ids, key).where(LISTED).join(ids.select(key), key, "left_semi").select(rows.columns)


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not in `ids`; rows that a filter of fixed size rules out are not shuffled."""
    every = marked(rows, ids, key)
    doubtful = every.where(LISTED).join(ids.select(key), key, "left_anti")
    return every.where(~F.col(LISTED)).select(rows.columns).union(doubtful.select(rows.columns))


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """`rows` joined with `found` (one row for each value of `keys`; `copies` is how many of `rows` have it).

    The rows of hot keys, fewer than 1 / HOT of them, meet a broadcast table and stay where they are; the others are shuffled by key."""
    rest = [c for c in found.columns if c not in (*keys, copies)]
    hot = found.where(F.col(copies) > total * HOT).select(*keys, *rest, F.lit(True).alias("_lt_hot"))
    near = rows.join(F.broadcast(hot), keys, "left")
    far = near.where("_lt_hot is null").select(rows.columns).join(found.where(F.col(copies) <= total * HOT).select(*keys, *rest), keys)
    columns = [*rows.columns, *rest]
    return near.where("_lt_hot").select(columns).union(far.select(columns))


def numbered(rows: DataFrame, key: str, counts: dict[int, int], order: str) -> DataFrame:
    """Adds `number`, from 0 on in each value of the integer column `key`, by no order that matters. `order` tells rows apart.

    `counts` has the rows of each value, few values for all. A value is cut into buckets of about BUCKET_ROWS rows, each numbered in a task of its own."""
    spark = rows.sparkSession
    shares = spark.createDataFrame([(int(k), 1 + int(n) // BUCKET_ROWS) for k, n in counts.items()], f"{key} long, _lt_buckets long")
    dealt = rows.join(F.broadcast(shares), key).withColumn("_lt_bucket", F.pmod(F.xxhash64(order), "_lt_buckets"))
    before = Window.partitionBy(key).orderBy("_lt_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each value, and one more for every BUCKET_ROWS rows
    firsts = dealt.groupBy(key, "_lt_bucket").count().select(key, "_lt_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_lt_first"))
    own = F.row_number().over(Window.partitionBy(key, "_lt_bucket").orderBy(order))
    found = dealt.withColumn("_lt_own", own).join(firsts, [key, "_lt_bucket"])
    return found.select(*rows.columns, (F.col("_lt_first") + F.col("_lt_own") - 1).alias("number"))


def bound_rows(df: DataFrame, most: int) -> int | None:
    """The number of rows if it is at most `most`, else None."""
    n = df.limit(most + 1).count()
    return n if n <= most else None
