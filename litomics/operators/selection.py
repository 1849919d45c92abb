"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch

#: Values of a group that one buffer holds; medians of larger groups are found by histograms.
MOST_VALUES = 1_000_000
#: Bits that a histogram looks at; 64 / BITS passes find one value among any.
BITS = 16


def ordered_bits(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and `bits`: whole numbers in the order of the values, one for each different value. NaN is above all; -0 is 0."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("_v").to_numpy(zero_copy_only=False).astype(float) + 0.0
            bits = v.view(np.int64)
            bits = np.where(np.isnan(v), np.iinfo(np.int64).max, np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(bits)], [*keys, "bits"])

    return rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", bits long")


def from_bits(rows: DataFrame, bits: str, name: str) -> DataFrame:
    """The values behind whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(bits).to_numpy(zero_copy_only=False).astype(np.int64)
            back = np.where(b < 0, np.int64(-(2**63)) - b - 1, b)
            value = np.where(b == np.iinfo(np.int64).max, np.nan, back.view(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + f", {name} double")


def by_histograms(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys and the median of each group, the mean of the middle two of an even number, by refining histograms.

    Each pass counts the values by their next BITS bits among those that share the bits found so far, so a group's buffer is 2 ** BITS counts at most, whatever the group, and only values near the
    middle are counted again."""
    spark = rows.sparkSession
    path = scratch(spark, "bits")
    ordered_bits(rows, keys, value).write.parquet(path)
    values = spark.read.parquet(path)
    on = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    n = values.groupBy(*keys).agg(F.count("*").alias("n"))
    # the two middle ranks, which are one for an odd number
    wanted = n.select(*keys, F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("rank"), F.lit(0).cast("long").alias("found")).select(*keys, F.col("rank").alias("at"), "rank", "found").distinct()
    for shift in range(64 - BITS, -1, -BITS):
        prefix = F.shiftright("bits", shift + BITS) if shift + BITS < 64 else F.lit(0).cast("long")
        asked = wanted.select(*keys, "found").distinct()
        near = values.withColumn("found", prefix)
        if shift + BITS < 64:
            near = near.join(F.broadcast(asked), on(near, asked, [*keys, "found"]), "left_semi")
        counts = near.groupBy(*keys, "found", F.shiftright("bits", shift).alias("next")).agg(F.count("*").alias("n"))
        before = Window.partitionBy(*keys, "found").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
        steps = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        met = wanted.join(steps, on(wanted, steps, [*keys, "found"])).where((wanted["rank"] >= steps["before"]) & (wanted["rank"] < steps["before"] + steps["n"]))
        narrowed = met.select(*[wanted[k] for k in keys], wanted["at"], (wanted["rank"] - steps["before"]).alias("rank"), steps["next"].alias("found"))
        step = scratch(spark, "step")
        narrowed.write.parquet(step)  # two rows for each group
        wanted = spark.read.parquet(step)
    return from_bits(wanted, "found", "_value").groupBy(*keys).agg(F.avg("_value").alias(name))


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys and the exact median of the values that are not null; groups without any are absent."""
    there = rows.where(F.col(value).isNotNull())
    large = there.groupBy(*keys).count().where(F.col("count") > MOST_VALUES).select(*keys)
    plain = lambda r: r.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), 0.5).alias(name))
    if large.isEmpty():
        return plain(there)
    same = [there[k].eqNullSafe(large[k]) for k in keys]
    return plain(there.join(F.broadcast(large), same, "left_anti")).unionByName(by_histograms(there.join(F.broadcast(large), same, "left_semi"), keys, value, name))
