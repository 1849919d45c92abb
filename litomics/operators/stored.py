"""Merges into stored tables: only the partitions that a batch touches are read and written again.

A table is a folder of Parquet, partitioned by `bucket`, a hash of the key, and by `version`, the number of the batch that wrote the bucket last. A batch writes the buckets of its keys under its own number
beside the versions before; a reader takes the newest version of each bucket. So a batch that fails leaves what was there, one that is run again finds its buckets written and changes nothing, and
readers never see half a bucket: a bucket is one file, which appears whole. On the driver is one number for each bucket. Batches have ascending numbers and are merged one at a time, as a stream's are."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .upsert import upsert

N_BUCKETS = 64


def bucket_of(keys: list[str], n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> dict[int, int]:
    """The newest version of each bucket: one row for each bucket reaches the driver. Of the files only their folders and footers are read."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return {}
    return {r["bucket"]: r["v"] for r in rows.groupBy("bucket").agg(F.max("version").alias("v")).collect()}


def _of(rows: DataFrame, newest: dict[int, int]) -> DataFrame:
    """Rows of these buckets' versions: a filter on folders alone."""
    by = F.create_map(*[F.lit(int(x)) for kv in newest.items() for x in kv]) if newest else None
    return rows.where(F.col("bucket").isin(list(newest)) & (F.col("version") == F.element_at(by, F.col("bucket")))) if newest else rows.limit(0)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as it stands."""
    return _of(spark.read.parquet(path), versions(spark, path)).drop("bucket", "version")


def merge_batch(batch: DataFrame, path: str, keys: list[str], rules: dict[str, str], number: int, n_buckets: int = N_BUCKETS) -> list[int]:
    """Merges a batch, unique by key, into the table at `path` by `upsert`'s rules; the buckets that were written.

    Buckets that have this batch or a later one are left alone. `n_buckets` is fixed for a table: choose it so that a bucket fits a task."""
    spark = batch.sparkSession
    new = batch.select(*keys, *rules).withColumn("bucket", bucket_of(keys, n_buckets))
    before = versions(spark, path)
    # at most n_buckets numbers
    touched = sorted(b for b in (r["bucket"] for r in new.select("bucket").distinct().collect()) if before.get(b, -1) < number)
    if not touched:
        return []
    known = {b: before[b] for b in touched if b in before}
    old = _of(spark.read.parquet(path), known) if known else spark.createDataFrame([], new.schema)
    merged = upsert(old, new.where(F.col("bucket").isin(touched)), ["bucket", *keys], rules).withColumn("version", F.lit(number))
    # a bucket is one task and one file; only the folders of this batch are replaced
    merged.repartition(len(touched), "bucket").sortWithinPartitions("bucket", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
    return touched


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all but the newest `keep` versions of each bucket, for readers of older ones that are done; how many were removed."""
    found: dict[int, list[int]] = {}
    for r in spark.read.parquet(path).select("bucket", "version").distinct().collect():  # buckets by versions that were not removed yet
        found.setdefault(r["bucket"], []).append(r["version"])
    old = [(b, v) for b, vs in found.items() for v in sorted(vs)[:-keep]]
    for b, v in old:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}/version={v}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(old)
