"""Which matrix features read out a pathway's nodes, and genes and annotations by way of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .upsert import first_per_key


def by_symbol(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """(pathway_id, node_id, feature_key) of gene nodes whose symbol is a feature's key, letter case ignored."""
    n = nodes.where("node_type = 'gene' and gene_symbol <> ''").select("pathway_id", "node_id", F.upper("gene_symbol").alias("feature_key"))
    return n.join(features.select(F.upper("feature_key").alias("feature_key")).distinct(), "feature_key").select("pathway_id", "node_id", "feature_key").distinct()


def by_regulon(nodes: DataFrame, regulon: DataFrame, features: DataFrame, every_pathway: bool = False) -> DataFrame:
    """(pathway_id, node_id, feature_key, sign) of a factor's targets that are features.

    A factor reads out at one node, the first by (pathway_id, node_id); with `every_pathway` at the first of each pathway."""
    n = nodes.where("gene_symbol <> ''").select("pathway_id", "node_id", F.upper("gene_symbol").alias("tf"))
    one = first_per_key(n, ["tf", "pathway_id"] if every_pathway else ["tf"], F.asc("pathway_id"), F.asc("node_id"))
    r = regulon.groupBy(F.upper("tf").alias("tf"), F.upper("target").alias("feature_key")).agg(F.max("sign").alias("sign"))
    return one.join(r, "tf").join(features.select(F.upper("feature_key").alias("feature_key")).distinct(), "feature_key").select("pathway_id", "node_id", "feature_key", "sign")


def genes_of_datasets(paper_genes: DataFrame, links: DataFrame) -> DataFrame:
    """(dataset_id, gene_symbol, mention_count, n_papers) by way of linked papers; a paper's mentions count once for each dataset."""
    g = paper_genes.groupBy("paper_id", "gene_symbol").agg(F.sum("mention_count").alias("m"))
    return g.join(links.select("paper_id", "dataset_id").distinct(), "paper_id").groupBy("dataset_id", "gene_symbol").agg(F.sum("m").cast("long").alias("mention_count"), F.count("*").alias("n_papers"))


def annotated_page(page: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """A page, already limited, with its annotations, the least of several; only the page's keys are looked up."""
    wanted = annotations.join(page.select(key).distinct(), key, "left_semi")
    rest = [c for c in annotations.columns if c != key]
    return page.join(wanted.groupBy(key).agg(F.min(F.struct(*rest)).alias("a")), key, "left").select("*", *[F.col(f"a.{c}").alias(c) for c in rest]).drop("a")


def used_bytes(files: DataFrame, project_datasets: DataFrame, project_samples: DataFrame) -> DataFrame:
    """Bytes of files that hang on a project's datasets or samples; a file hangs on one of the two."""
    d = files.where("dataset_id is not null").join(project_datasets.select("dataset_id").distinct(), "dataset_id", "left_semi").select("size_bytes")
    s = files.where("sample_id is not null").join(project_samples.select("sample_id").distinct(), "sample_id", "left_semi").select("size_bytes")
    return d.union(s).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("used_bytes"))


def manifest(scores: DataFrame) -> DataFrame:
    """Counters of a scoring run, from its rows."""
    return scores.agg(
        F.count("*").alias("n_rows"), F.countDistinct("pathway_id").alias("n_pathways"), F.countDistinct("sample_id").alias("n_cases"), F.count_if(F.col("null_sd") == 0).alias("n_zero_sd"),
        F.sum("n_seeds_on_graph").cast("long").alias("n_seeds_on_graph"), F.sum("n_seeds_off_graph").cast("long").alias("n_seeds_off_graph"),
    )
