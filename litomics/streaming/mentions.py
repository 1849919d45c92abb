"""Mentions that arrive as files: each micro-batch is merged into the stored counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stored import N_BUCKETS, merge_batch
from ..operators.upsert import mention_counts

SCHEMA = "paper_id long, symbol string, mention_count long, ts timestamp"
KEYS = ["paper_id", "symbol"]


def windowed(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Mentions by symbol and event-time window; rows later than `late` are dropped by the watermark, as its contract says."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "symbol").agg(F.sum("mention_count").alias("mentions"))


def merge_buckets(spark: SparkSession, landing: str, table: str, checkpoint: str, n_buckets: int = N_BUCKETS) -> StreamingQuery:
    """Merge every new file of `landing` into `table` (see operators.stored). Counts are summed within a micro-batch, then put over stored ones.

    A micro-batch reads and writes the buckets of its keys only, and one that is run again changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        counts = batch.groupBy(*KEYS).agg(F.sum("mention_count").cast("long").alias("mention_count"))
        merge_batch(counts, table, KEYS, {"mention_count": "new"}, epoch, n_buckets)

    stream = spark.readStream.schema(SCHEMA).parquet(landing)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_files(spark: SparkSession, landing: str, table: str, checkpoint: str) -> StreamingQuery:
    """The same with a whole snapshot of `table` for each micro-batch, v=0, v=1 and so on: for tables so small that each of their versions is worth keeping. A batch that is run again writes its snapshot again."""

    def merge(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        rows = batch.select("paper_id", "symbol", "mention_count")
        stored = session.read.parquet(f"{table}/v={epoch - 1}") if epoch else session.createDataFrame([], "paper_id long, symbol string, mention_count long")
        mention_counts(stored, rows, KEYS).write.mode("overwrite").parquet(f"{table}/v={epoch}")

    stream = spark.readStream.schema(SCHEMA).parquet(landing)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
