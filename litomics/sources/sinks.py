"""Exports: nested JSON, flat CSV, fixed column lists, partitioned results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(papers: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Papers with a JSON text `doc` that holds each child table's rows, sorted, under its name."""
    out = papers
    for name, child in children.items():
        fields = [c for c in child.columns if c != key]
        lists = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(lists, key, "left")
    return out.select(key, F.to_json(F.struct(*[F.coalesce(F.col(c), F.array()).alias(c) if c in children else F.col(c) for c in out.columns])).alias("doc"))


def flat(papers: DataFrame, key: str, labels: DataFrame, label: str) -> DataFrame:
    """Papers with their labels joined by bars, sorted."""
    joined = labels.groupBy(key).agg(F.concat_ws("|", F.array_sort(F.collect_set(label))).alias(label))
    return papers.join(joined, key, "left").withColumn(label, F.coalesce(label, F.lit("")))


def as_text(c: Column, kind: str) -> Column:
    """A column for a flat file: arrays by semicolons, maps as k=v sorted by key, null as empty."""
    if kind.startswith("array"):
        return F.coalesce(F.array_join(c.cast("array<string>"), ";"), F.lit(""))
    if kind.startswith("map"):
        return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ";"), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def export_rows(datasets: DataFrame, columns: list[str], order: str = "accession") -> DataFrame:
    """The listed columns in that order as text, by `order`."""
    kinds = dict(datasets.dtypes)
    return datasets.select(*[as_text(F.col(c), kinds[c]).alias(c) for c in columns]).orderBy(order)


def provenance(datasets: DataFrame, axis: str, access: str, join_key: str) -> DataFrame:
    """Counts for an export's head: all, by axis, by access, with a join key; one row each."""
    total = datasets.agg(F.lit("total").alias("what"), F.lit("").alias("value"), F.count("*").alias("n"))
    by = lambda c: datasets.groupBy(F.lit(c).alias("what"), F.coalesce(c, F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    keyed = datasets.where(F.size(join_key) > 0).agg(F.lit(join_key).alias("what"), F.lit("").alias("value"), F.count("*").alias("n"))
    return total.unionByName(by(axis)).unionByName(by(access)).unionByName(keyed)


def write_version(rows: DataFrame, path: str, version: str) -> None:
    """Results by method version: writing one again replaces it and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


# What an export may show of a contract.
CONTRACT = ("matrix_pointer", "proteomics_modality", "tissue_raw", "disease_raw", "ref_pmids", "ref_dois", "monogenic_gene_hit")


def contract(metadata: Column, access: Column) -> Column:
    """struct<contract, access_controlled>: the allowed keys of the metadata's contract, each as JSON text; null where there is no contract or an empty one."""
    held = F.get_json_object(metadata, "$.contract")
    keys = F.struct(*[F.get_json_object(held, f"$.{k}").alias(k) for k in CONTRACT])
    there = F.size(F.coalesce(F.json_object_keys(held), F.array().cast("array<string>"))) > 0
    return F.struct(F.when(there, keys).alias("contract"), F.coalesce(access == "controlled", F.lit(False)).alias("access_controlled"))


def write_occurrences(rows: DataFrame, path: str) -> None:
    """sample_accession, variant_key, gene_symbol, variant_classification as text with tabs and a header."""
    columns = ["sample_accession", "variant_key", "gene_symbol", "variant_classification"]
    rows.select(columns).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def write_regulons(rows: DataFrame, path: str) -> None:
    """tf, target, mode, sources, n_references as JSON lines; line breaks leave `sources`."""
    rows.select("tf", "target", "mode", F.regexp_replace("sources", "[\\r\\n]", "").alias("sources"), "n_references").write.mode("overwrite").json(path)
