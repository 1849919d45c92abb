"""Counts per project, distributions and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def status_counts(rows: DataFrame, group: str, status: str, values: list[str]) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values])


def top_groups(rows: DataFrame, group: str, by: str, n: int, weight: Column | None = None, drop_blank: bool = True) -> DataFrame:
    """The n largest values of `by` in each group, ties by value. Blank ones take their rank first and are dropped after it."""
    counted = rows.groupBy(group, by).agg((F.count("*") if weight is None else F.sum(weight)).cast("long").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc_nulls_first(by)))
    out = counted.withColumn("rank", rank).where(F.col("rank") <= n)
    return out.where(F.col(by).isNotNull() & (F.col(by) != "")) if drop_blank else out


def child_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with a count of rows of each child table; each child is counted before it is joined, so counts do not multiply."""
    out = parents
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def sample_totals(datasets: DataFrame, samples: DataFrame, group: str) -> DataFrame:
    """Samples per group: real rows if there are any, else the sum of the declared numbers."""
    real = samples.groupBy(group).agg(F.count("*").alias("real"))
    said = datasets.groupBy(group).agg(F.coalesce(F.sum("n_samples"), F.lit(0)).cast("long").alias("said"))
    return said.join(real, group, "left").select(group, F.when(F.coalesce("real", F.lit(0)) > 0, F.col("real")).otherwise(F.col("said")).alias("total_samples"))


def known_total(rows: DataFrame, group: str, size: str, marked: Column) -> DataFrame:
    """Bytes per group, unknown if any is unknown; and whether all rows are marked."""
    return rows.groupBy(group).agg(F.when(F.count("*") == F.count(size), F.sum(size)).alias("total_bytes"), F.count_if(marked).alias("n_marked"), F.count("*").alias("n_rows"))


def page(rows: DataFrame, ordering: str | None, allowed: dict[str, Column], default: str, tie: str, number: int = 1, size: int = 50) -> DataFrame:
    """One page of rows by an allowed ordering; any other ordering is the default."""
    first = allowed.get(ordering or default, allowed[default])
    return rows.orderBy(first, F.asc(tie)).offset((number - 1) * size).limit(size)


def newest_first(rows: DataFrame, at: str, tie: str) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(at), F.desc(tie))


def report_slice(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a report in the order given, which has to tell all rows apart."""
    return rows.orderBy(*order).limit(n)


def first_author_countries(authors: DataFrame, papers: DataFrame, group: str, n: int = 30) -> DataFrame:
    """The n most frequent countries of first authors (position 1) of included papers in each group; unknown ones left out before ranking."""
    first = authors.where((F.col("position") == 1) & (F.coalesce("country", F.lit("")) != ""))
    return top_groups(first.join(papers.where("included"), "paper_id"), group, "country", n)


def category_counts(categories: DataFrame, papers: DataFrame, group: str) -> DataFrame:
    """Included papers of each category in each group; a paper counts in each of its categories."""
    return categories.join(papers.where("included"), "paper_id").groupBy(group, "category").agg(F.count("*").alias("n"))
