"""Wide matrix files: a text column `feature` first, then a float column for each sample, rows in order of the feature.

A file is written once and read by rows: small row groups whose features do not overlap let a filter on `feature` skip all but a few of them. The digest of a matrix is that of its parts of
PART_ROWS rows in feature order, so it depends on the content alone and not on how many files or tasks wrote it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import ROW_INDEX, numbered

FEATURE = "feature"
#: Rows under one digest.
PART_ROWS = 1024
#: Bytes of a row group as it is written; a wide row is long, so a group is some hundred rows.
GROUP_BYTES = 1 << 20
#: Features that are looked up by a filter; more are joined.
MOST_LISTED = 5000


def wide(long: DataFrame, samples: list[str], feature: str = FEATURE, sample: str = "sample", value: str = "value") -> DataFrame:
    """A matrix of (feature, sample, value): a column for each of `samples`, in sorted order, whether it has values or not. A pair without a value is null, which is not 0.

    The list is given, so that the schema does not depend on the rows; values of other samples are left out. Of a repeated pair the largest value stays."""
    names = sorted(set(samples))
    columns = long.groupBy(F.col(feature).alias(FEATURE)).pivot(sample, names).agg(F.max(F.col(value).cast("float")))
    return columns.select(FEATURE, *[F.col(f"`{n}`") for n in names])


def burden_matrix(burden: DataFrame, samples: list[str]) -> DataFrame:
    """The wide form of (gene, sample, burden)."""
    return wide(burden, samples, "gene", "sample", "burden")


def write_matrix(matrix: DataFrame, path: str, group_bytes: int = GROUP_BYTES) -> None:
    """Writes a matrix in feature order; its features have to be unique and not null. Ranges of features go to tasks, so no task sorts them all."""
    if matrix.columns[0] != FEATURE:
        raise ValueError(f"the first column is {matrix.columns[0]!r}, not {FEATURE!r}")
    floats = [F.col(f"`{c}`").cast("float").alias(c) for c in matrix.columns[1:]]
    ordered = matrix.where(F.col(FEATURE).isNotNull()).select(FEATURE, *floats).repartitionByRange(FEATURE).sortWithinPartitions(FEATURE)
    ordered.write.mode("overwrite").option("parquet.block.size", group_bytes).option("parquet.page.size", max(1024, group_bytes // 8)).parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The whole matrix; an error if its first column is not `feature` or another is no float."""
    rows = spark.read.parquet(path)
    kinds = rows.dtypes
    if not kinds or kinds[0] != (FEATURE, "string"):
        raise ValueError(f"the first column is {kinds[0] if kinds else None!r}, not a text column {FEATURE!r}")
    if wrong := [c for c, k in kinds[1:] if k != "float"]:
        raise ValueError(f"no float columns: {', '.join(wrong)}")
    return rows


def features(spark: SparkSession, path: str) -> DataFrame:
    """feature, row_index: the features of a matrix and their rows. No other column is read."""
    return numbered(read_matrix(spark, path).select(FEATURE))


def rows_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows of the features in `wanted` (feature), and no others: the scan skips row groups and pages without them.

    Up to MOST_LISTED features become a filter of the scan. More are joined, between the least and the greatest of them."""
    some = [r[0] for r in wanted.select(FEATURE).where(F.col(FEATURE).isNotNull()).distinct().limit(MOST_LISTED + 1).collect()]
    rows = read_matrix(spark, path)
    if len(some) <= MOST_LISTED:
        return rows.where(F.col(FEATURE).isin(some)) if some else rows.limit(0)
    low, high = wanted.agg(F.min(FEATURE), F.max(FEATURE)).first()
    return rows.where(F.col(FEATURE).between(low, high)).join(wanted.select(FEATURE).distinct(), FEATURE, "left_semi")


def rows_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows with the numbers in `wanted` (row_index), with their number: first the features alone say which they are, then only these are read."""
    named = features(spark, path).join(wanted.select(ROW_INDEX).distinct(), ROW_INDEX, "left_semi")
    return rows_of(spark, path, named).join(named, FEATURE)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """part, n_rows, digest of each PART_ROWS rows of a matrix file, in feature order."""
    matrix = read_matrix(spark, path)
    bits = [F.coalesce(F.hex(F.col(f"`{c}`").cast("double").cast("string").cast("binary")), F.lit("-")) for c in matrix.columns[1:]]
    rows = numbered(matrix).select(F.floor(F.col(ROW_INDEX) / PART_ROWS).alias("part"), F.struct(ROW_INDEX, F.sha2(F.concat_ws("|", F.hex(F.col(FEATURE).cast("binary")), *bits), 256).alias("d")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["d"]), "")
    return rows.groupBy("part").agg(F.count("*").alias("n_rows"), F.sha2(joined, 256).alias("digest"))


def digest(spark: SparkSession, path: str) -> str:
    """One digest of a matrix: of its columns, and of its parts in order. There is one row here for each PART_ROWS rows."""
    head = "|".join(read_matrix(spark, path).columns)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda r: r["digest"])
    return digests(spark, path).agg(F.sha2(F.concat(F.lit(head), F.array_join(parts, "")), 256)).first()[0]
