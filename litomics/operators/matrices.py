"""Feature by sample matrices in long form, pairing of samples, cohort statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(wide: DataFrame, feature: str = "feature") -> DataFrame:
    """(feature, role, case_id, value) of a wide matrix whose columns are T_<case> and N_<case>."""
    columns = [c for c in wide.columns if c not in (feature, "row_index")]
    long = wide.unpivot([feature], columns, "column", "value")
    return long.select(feature, F.when(F.col("column").startswith("T_"), "tumor").when(F.col("column").startswith("N_"), "normal").otherwise("sample").alias("role"), F.regexp_replace("column", "^[TN]_", "").alias("case_id"), "value")


def last_row_wins(long: DataFrame) -> DataFrame:
    """One value for each (feature, sample): that of the last row (row_index) with the feature."""
    return long.groupBy("feature", "sample").agg(F.max_by("value", "row_index").alias("value"))


def aligned(a: DataFrame, b: DataFrame, key: str = "feature") -> DataFrame:
    """Keys of two tables: how many both have, and how many only one has."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    return x.join(y, key, "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_common"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_discarded"))


def catalogue(rows: DataFrame) -> DataFrame:
    """Feature keys in upper case with the index of their first row."""
    return rows.groupBy(F.upper("feature").alias("feature_key")).agg(F.min("row_index").alias("row_index"))


def burden(occurrences: DataFrame) -> DataFrame:
    """Distinct variants per (gene, sample). A pair without any has no row: absent is not zero."""
    return occurrences.select("gene", "sample", "variant_key").distinct().groupBy("gene", "sample").agg(F.count("*").cast("int").alias("burden"))


def pairs(samples: DataFrame, case: str, role: str, sample: str, tumor: object = "tumor", normal: object = "normal") -> DataFrame:
    """(case, tumor sample, normal sample) of cases with exactly one sample in each role; cases with more in a role are left out."""
    t, n = F.col(role) == tumor, F.col(role) == normal
    per = samples.groupBy(case).agg(F.count_if(t).alias("n_t"), F.count_if(n).alias("n_n"), F.max(F.when(t, F.col(sample))).alias("tumor_sample"), F.max(F.when(n, F.col(sample))).alias("normal_sample"))
    return per.where("n_t = 1 and n_n = 1").select(case, "tumor_sample", "normal_sample")


def unpaired(samples: DataFrame, case: str, role: str, tumor: object = "tumor", normal: object = "normal") -> DataFrame:
    """Cases by what keeps them from being a pair."""
    per = samples.groupBy(case).agg(F.count_if(F.col(role) == tumor).alias("t"), F.count_if(F.col(role) == normal).alias("n"))
    kind = F.when((F.col("t") == 1) & (F.col("n") == 1), "paired").when((F.col("t") > 1) | (F.col("n") > 1), "several").when(F.col("t") == 1, "tumor_only").when(F.col("n") == 1, "normal_only").otherwise("none")
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_cases"))


def deltas(values: DataFrame, paired: DataFrame) -> DataFrame:
    """(feature, tumor_sample, delta) of pairs whose two values exist; values are made double before they are subtracted."""
    t = values.select("feature", F.col("sample").alias("tumor_sample"), F.col("value").cast("double").alias("t"))
    n = values.select("feature", F.col("sample").alias("normal_sample"), F.col("value").cast("double").alias("n"))
    return t.join(paired, "tumor_sample").join(n, ["feature", "normal_sample"]).where("t is not null and n is not null").select("feature", "tumor_sample", (F.col("t") - F.col("n")).alias("delta"))


def cohort_sd(rows: DataFrame) -> DataFrame:
    """Sample standard deviation of each feature's deltas; 0 where there are fewer than two."""
    return rows.groupBy("feature").agg(F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("sd"))


def scaled(delta: Column, sd: Column) -> Column:
    """A delta over its standard deviation; over 1 where that is 0."""
    return delta / F.when(sd == 0, 1.0).otherwise(sd)


def ulm(rows: DataFrame, keys: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Per group the t statistic of the slope of y on x.

    None with fewer than `least` or 3 rows, without variance in x, or with a perfect fit."""
    s = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.expr(f"regr_sxx({y}, {x})").alias("sxx"), F.expr(f"regr_sxy({y}, {x})").alias("sxy"), F.expr(f"regr_syy({y}, {x})").alias("syy")
    )
    mse = (F.col("syy") - F.col("sxy") * F.col("sxy") / F.when(F.col("sxx") > 1e-12, F.col("sxx"))) / F.when(F.col("n") > 2, F.col("n") - 2)
    t = (F.col("sxy") / F.when(F.col("sxx") > 1e-12, F.col("sxx"))) / F.sqrt(mse / F.when(F.col("sxx") > 1e-12, F.col("sxx")))
    # a residual at the size of rounding is a perfect fit
    fine = (F.col("n") >= max(3, least)) & (F.col("sxx") > 1e-12) & (mse > 1e-12 * F.greatest("syy", F.lit(1e-300)))
    return s.select(*keys, F.col("n").alias("n_targets"), F.when(fine, t).alias("t"))
