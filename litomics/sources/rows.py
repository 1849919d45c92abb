"""Numbers of rows in files, in file order, without a global sort."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROW_INDEX = "row_index"


def _split(rows: DataFrame) -> tuple[Column, Column]:
    """The file and the beginning of the split that a row, as a file reader gives it, comes from. Readers that tell no file plan their tasks in file order."""
    try:
        file, block = (rows.select(f"_metadata.{c}") and F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start"))
        return file, block
    except AnalysisException:
        return F.lit(""), F.spark_partition_id().cast("long")


def placed(rows: DataFrame, name: str = ROW_INDEX) -> DataFrame:
    """`rows`, as a file reader gives them (before any filter), with a struct that orders them as `numbered` does. It is no number, but files are read once for it.

    Spark reads each split of a file in one task and in file order, so a running id orders the rows of a split."""
    file, block = _split(rows)
    return rows.select("*", F.struct(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("id")).alias(name))


def numbered(rows: DataFrame, name: str = ROW_INDEX) -> DataFrame:
    """`rows`, as a file reader gives them (before any filter), with the number of each row from 0 on: files by path, rows in file order.

    Spark reads a file in splits. Rows are counted for each split; prefix sums of these counts, one row for each split, say where a split begins, and a row's number in its split is the distance of its
    running id from the split's first. So no row is sorted or moved but by the join with its split's beginning, which is small."""
    file, block = _split(rows)
    place = rows.select("*", file.alias("_file"), block.alias("_block"), F.monotonically_increasing_id().alias("_id"))
    per = place.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return place.join(starts, ["_file", "_block"]).select(*rows.columns, (F.col("_id") + F.col("_shift")).alias(name))


def first_rows(rows: DataFrame, *keys: str, order: str = ROW_INDEX) -> DataFrame:
    """Of rows with equal keys the first by number, whole: its columns are never mixed with those of another row."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
