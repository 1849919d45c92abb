"""Pathway graphs: edges, quality, and how seeds connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (pathway, source, target): subtypes united in order of first sight, first relation type, count of merged rows."""
    rows = edges.groupBy("pathway_id", "source", "target").agg(
        F.array_sort(F.collect_list(F.struct("seq", "relation", "subtypes"))).alias("r")
    )
    return rows.select("pathway_id", "source", "target", F.col("r")[0]["relation"].alias("relation"), F.array_distinct(F.flatten(F.transform("r", lambda x: x["subtypes"]))).alias("subtypes"), (F.size("r") - 1).alias("n_collapsed"))


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, "r.*")


def quality(pathways: DataFrame, edges: DataFrame, min_edges: int = 10, min_signed: float = 0.5) -> DataFrame:
    """Edges and signed edges of each pathway, and why it is left out: no_edges, few_edges, low_signed; kept if null."""
    per = edges.groupBy("pathway_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("sign") != 0).alias("n_signed"))
    out = pathways.join(per, "pathway_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_edges", "n_signed")})
    reason = F.when(F.col("n_edges") == 0, "no_edges").when(F.col("n_edges") < min_edges, "few_edges").when(F.col("n_signed") / F.col("n_edges") < min_signed, "low_signed")
    return out.withColumn("reason", reason)


def adjacency(edges: DataFrame, unsigned: float = 0.3) -> DataFrame:
    """Edges with weights: the sign, or `unsigned` for 0, over the sum of absolute weights that leave the source."""
    w = F.when(F.col("sign") == 0, F.lit(unsigned)).otherwise(F.col("sign").cast("double"))
    total = F.sum(F.abs("w")).over(Window.partitionBy("pathway_id", "source"))
    return edges.withColumn("w", w).withColumn("weight", F.col("w") / total).drop("w")


def connectivity(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Gene nodes with a seed: (pathway_id, node_id, gene, n_seeds, category); no_out, blind (no signed edge out) or useful.

    seeds: gene_symbol, direction; neutral ones do not count. Genes meet without regard to letter case."""
    s = seeds.where("direction <> 'neutral'").groupBy(F.upper("gene_symbol").alias("gene")).agg(F.count("*").alias("n_seeds"))
    out = edges.groupBy(F.col("source").alias("node_id"), "pathway_id").agg(F.count("*").alias("n_out"), F.count_if(F.col("sign") != 0).alias("n_signed"))
    seeded = nodes.where("node_type = 'gene' and gene_symbol <> ''").select("pathway_id", "node_id", F.upper("gene_symbol").alias("gene")).join(s, "gene")
    kind = F.when(F.col("n_out").isNull(), "no_out").when(F.col("n_signed") == 0, "blind").otherwise("useful")
    return seeded.join(out, ["pathway_id", "node_id"], "left").select("pathway_id", "node_id", "gene", "n_seeds", kind.alias("category"))


def connectivity_by_pathway(classified: DataFrame) -> DataFrame:
    """Per pathway: seeded nodes by category, share without an edge out, seeds involved (each gene's once)."""
    per = classified.groupBy("pathway_id", "gene").agg(F.count("*").alias("n"), F.max("n_seeds").alias("n_seeds"), *[F.count_if(F.col("category") == c).alias(c) for c in ("no_out", "blind", "useful")])
    return per.groupBy("pathway_id").agg(
        F.sum("n").cast("long").alias("n_nodes"), *[F.sum(c).cast("long").alias(f"n_{c}") for c in ("no_out", "blind", "useful")],
        (F.sum("no_out").cast("double") / F.sum("n")).alias("no_out_share"), F.sum("n_seeds").cast("long").alias("n_seeds"),
    )


def connectivity_by_gene(classified: DataFrame) -> DataFrame:
    """Genes that are without an edge out in all their nodes of some pathway: pathways with the gene, and such pathways."""
    per = classified.groupBy("gene", "n_seeds", "pathway_id").agg(F.bool_and(F.col("category") == "no_out").alias("isolated"))
    return per.groupBy("gene", "n_seeds").agg(F.count("*").alias("n_pathways"), F.count_if("isolated").alias("n_isolated")).where("n_isolated > 0")


def verdict(classified: DataFrame, least_useful: float = 0.6) -> DataFrame:
    """Totals by category, and a warning if too few nodes are useful."""
    out = classified.agg(F.count("*").alias("n_total"), *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in ("no_out", "blind", "useful")])
    return out.withColumn("warn", (F.col("n_total") > 0) & (F.col("n_useful") / F.when(F.col("n_total") > 0, F.col("n_total")) < least_useful))


def out_degree_quartiles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rank quartile (0..3) of each node's out-degree in its pathway: floor(4 * rank / n), ties by node."""
    degree = edges.groupBy("pathway_id", F.col("source").alias("node_id")).agg(F.count("*").alias("degree"))
    rows = nodes.select("pathway_id", "node_id").join(degree, ["pathway_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    own = Window.partitionBy("pathway_id")
    return rows.withColumn("quartile", F.floor((F.row_number().over(own.orderBy("degree", "node_id")) - 1) * 4 / F.count("*").over(own)).cast("int"))
