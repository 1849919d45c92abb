"""Benjamini-Hochberg in families, and the report over scored pathways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch
from ..sources.rows import numbered
from .selection import medians

SCOPES = {"population": ("pathway_id", "across_samples"), "individual": ("sample_id", "across_pathways")}


#: Tests of one family that one task sorts; larger families are ranked by ranges.
MOST_TESTS = 1_000_000
#: Tests whose least step is worked out in one task.
CHUNK_TESTS = 100_000


def adjust(scores: DataFrame, scope: str) -> DataFrame:
    """Scores with q value, method and family size of a scope.

    Rows with null_sd 0 are no tests: they leave the families, get no q and a family of 0. Equal p end with equal q. Families of any size are taken: those of more than MOST_TESTS
    are dealt over tasks by ranges of p (see `ranked_by_ranges`), with the same result."""
    part, suffix = SCOPES[scope]
    is_test = F.coalesce(F.col("null_sd") != 0, F.lit(False))
    q, method, m = f"q_value_{suffix}", f"fdr_method_{suffix}", f"fdr_n_tests_{suffix}"
    done = lambda rows, value, size: rows.withColumns({q: value, method: F.lit("benjamini_hochberg"), m: size}).select(*scores.columns, q, method, m)
    tests = scores.where(is_test)
    large = tests.groupBy(part).count().where(F.col("count") > MOST_TESTS).select(part)
    if large.isEmpty():
        tested = done(*stepped(tests, part))
    else:
        same = tests[part].eqNullSafe(large[part])
        tested = done(*stepped(tests.join(F.broadcast(large), same, "left_anti"), part)).unionByName(done(*ranked_by_ranges(tests.join(F.broadcast(large), same, "left_semi"), part)))
    # rows that are no tests need no rank, so they are neither shuffled nor sorted
    return tested.unionByName(done(scores.where(~is_test), F.lit(None).cast("double"), F.lit(0).cast("long")))


def _step(m: str, rank: str) -> Column:
    return F.least(F.col("p_empirical") * F.col(m) / F.col(rank), F.lit(1.0))


def stepped(tests: DataFrame, part: str) -> tuple[DataFrame, Column, Column]:
    """Tests with what their q and family size are, each family in one window."""
    family = Window.partitionBy(part)
    down = family.orderBy(F.desc("rk")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = tests.withColumn("rk", F.row_number().over(family.orderBy("p_empirical", "id"))).withColumn("m", F.count("*").over(family))
    return ranked, F.min(_step("m", "rk")).over(down), F.col("m")


def ranked_by_ranges(tests: DataFrame, part: str) -> tuple[DataFrame, Column, Column]:
    """The same for families of any size, in two passes.

    Ranges of (family, p, id) are sorted in tasks and written; a row's number in these files, less its family's first, is its rank. Then the least step from a rank on is the least of
    its own chunk of CHUNK_TESTS ranks and of the later chunks, which are one row each."""
    spark = tests.sparkSession
    path = scratch(spark, "ranked")
    keys = [part, "p_empirical", "id"]
    tests.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
    rows = numbered(spark.read.schema(tests.schema).parquet(path), "_n")
    families = rows.groupBy(F.col(part).alias("_f")).agg(F.min("_n").alias("_first"), F.count("*").alias("m"))
    rank = rows.join(F.broadcast(families), rows[part].eqNullSafe(families["_f"])).withColumn("rk", F.col("_n") - F.col("_first") + 1).withColumn("_chunk", F.floor((F.col("rk") - 1) / CHUNK_TESTS))
    later = Window.partitionBy("_f").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rank.groupBy("_f", "_chunk").agg(F.min(_step("m", "rk")).alias("_least")).select(F.col("_f").alias("_g"), F.col("_chunk").alias("_c"), F.min("_least").over(later).alias("_later"))
    own = Window.partitionBy("_f", "_chunk").orderBy(F.desc("rk")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rank.withColumn("_own", F.min(_step("m", "rk")).over(own)).join(chunks, F.col("_f").eqNullSafe(F.col("_g")) & (F.col("_chunk") == F.col("_c")))
    return both, F.least("_own", "_later"), F.col("m")


def taxonomy(pathways: DataFrame, scores: DataFrame, threshold: float = 0.05) -> DataFrame:
    """How many pathways are without rows, without tests, significant or not; pathways without rows count."""
    per = scores.groupBy("pathway_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("null_sd") != 0).alias("n_tests"), F.count_if(F.col("q_value_across_samples") < threshold).alias("n_hits"))
    kind = (
        F.when(F.coalesce("n_rows", F.lit(0)) == 0, "no_readout").when(F.col("n_tests") == 0, "no_seed").when(F.col("n_hits") > 0, "attributable").otherwise("not_attributable")
    )
    return pathways.join(per, "pathway_id", "left").groupBy(kind.alias("class")).agg(F.count("*").alias("n_pathways"))


def population(pathways: DataFrame, scores: DataFrame, edges: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Per significant pathway: significant and tested samples, median z of the tested, least q, share of unsigned edges."""
    tested = F.col("null_sd") != 0
    per = scores.groupBy("pathway_id").agg(
        F.count_if(F.col("q_value_across_samples") < threshold).alias("n_attributable"), F.count_if(tested).alias("n_evaluable"),
        F.min("q_value_across_samples").alias("q_min"),
    ).where("n_attributable > 0")
    middle = medians(scores.where(tested), ["pathway_id"], "z_score", "z_median")
    unsigned = edges.groupBy("pathway_id").agg(F.avg(F.when(F.col("sign") == 0, 1.0).otherwise(0.0)).alias("unsigned_fraction"))
    columns = [*pathways.columns, *[c for c in per.columns if c != "pathway_id"]]
    columns.insert(columns.index("q_min"), "z_median")
    return pathways.join(per, "pathway_id").join(middle, "pathway_id", "left").select(columns).join(unsigned, "pathway_id", "left").orderBy(F.asc_nulls_last("q_min"), "pathway_id")


def individual(scores: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Per sample with significant pathways: how many, which, and the least q."""
    return scores.where(F.col("q_value_across_pathways") < threshold).groupBy("sample_id").agg(
        F.count("*").alias("n_pathways"), F.min("q_value_across_pathways").alias("q_min"), F.array_join(F.array_sort(F.collect_list(F.col("pathway_id").cast("string"))), ",").alias("pathways")
    )


def sensitivity(scores: DataFrame, thresholds: tuple[float, ...] = (0.05, 0.10, 0.25)) -> DataFrame:
    """Significant pairs at each threshold, in one pass."""
    return scores.agg(*[F.count_if(F.col("q_value_across_samples") < t).alias(f"q_{round(100 * t)}") for t in thresholds], F.countDistinct(F.when(F.col("q_value_across_samples") < thresholds[0], F.col("sample_id"))).alias("n_samples"))
