"""Links between papers and datasets, in and out of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def materialise(links: DataFrame, project_papers: DataFrame, project_datasets: DataFrame) -> DataFrame:
    """(project_id, paper_id, dataset_id) of links with both ends in one project, once each."""
    return (
        links.select("paper_id", "dataset_id").distinct()
        .join(project_papers.select("project_id", "paper_id").distinct(), "paper_id")
        .join(project_datasets.select("project_id", "dataset_id").distinct(), ["project_id", "dataset_id"])
        .select("project_id", "paper_id", "dataset_id")
    )


def orphans(links: DataFrame, papers: DataFrame, datasets: DataFrame) -> DataFrame:
    """Links with one end only in the project: (kind, paper_id, dataset_id), the missing end under its kind."""
    pairs = links.select("paper_id", "dataset_id").distinct()
    p, d = papers.select("paper_id").distinct(), datasets.select("dataset_id").distinct()
    add_dataset = pairs.join(p, "paper_id", "left_semi").join(d, "dataset_id", "left_anti").select(F.lit("dataset").alias("kind"), "paper_id", "dataset_id")
    add_paper = pairs.join(d, "dataset_id", "left_semi").join(p, "paper_id", "left_anti").select(F.lit("paper").alias("kind"), "paper_id", "dataset_id")
    return add_dataset.unionByName(add_paper)


def store_pending(found: DataFrame) -> DataFrame:
    """Distinct (accession, pmid) with the least source."""
    return found.groupBy("accession", "pmid").agg(F.min("source").alias("source"))


def resolve_pending(pending: DataFrame, datasets: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links whose two ends exist by now, and what still waits."""
    d, p = datasets.select("accession", "dataset_id").dropDuplicates(["accession"]), papers.select("pmid", "paper_id").dropDuplicates(["pmid"])
    done = pending.join(d, "accession").join(p, "pmid")
    return done.select("paper_id", "dataset_id", "source"), pending.join(done.select("accession", "pmid"), ["accession", "pmid"], "left_anti")


def link_missing(ids: DataFrame, linked: DataFrame, key: str, status: str = "pending") -> DataFrame:
    """Rows to add for ids that are not linked yet."""
    return ids.select(key).distinct().join(linked.select(key), key, "left_anti").withColumn("curation_status", F.lit(status))


def co_occurring(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Pairs of different items in one group, and in how many groups: (a, b, n_groups), a < b.

    The pairs of a group are its result, so they are as many as it has pairs of items. Groups of more than TILE_ITEMS are cut into tiles of items, and a pair of tiles is what meets in a task: each item goes to as
    many tasks as there are tiles, and no task gets more than two tiles."""
    left, right = tiles(rows, group, item, "a"), tiles(rows, group, item, "b")
    # a pair of items meets where their own tiles do, and nowhere else
    met = left.join(right, [group, "_low", "_high"]).where("a < b and least(a_tile, b_tile) = _low and greatest(a_tile, b_tile) = _high")
    return met.groupBy("a", "b").agg(F.count("*").alias("n_groups"))


#: Items of a group that one task takes whole.
TILE_ITEMS = 2000


def tiles(rows: DataFrame, group: str, item: str, name: str) -> DataFrame:
    """Each distinct item of a group with its tile, once for every pair of tiles (_low, _high) that it belongs to."""
    each = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, F.col(item).alias(name)).distinct()
    large = each.groupBy(group).agg(F.ceil(F.count("*") / TILE_ITEMS).cast("int").alias("_n")).where("_n > 1")
    tile = F.pmod(F.xxhash64(name), F.coalesce("_n", F.lit(1))).cast("int").alias(f"{name}_tile")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)).alias("_other")
    every = each.join(large, group, "left").select(group, name, tile, other)
    return every.withColumns({"_low": F.least(f"{name}_tile", "_other"), "_high": F.greatest(f"{name}_tile", "_other")}).drop("_other")


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (pathway_id, source, target by entry id) with the node ids of both ends, null where an end is unknown."""
    end = lambda name: nodes.select("pathway_id", F.col("entry_id").alias(name), F.col("node_id").alias(f"{name}_id"))
    return edges.join(end("source"), ["pathway_id", "source"], "left").join(end("target"), ["pathway_id", "target"], "left")


def edge_counts(resolved: DataFrame) -> DataFrame:
    """Per pathway: edges with both ends, and those dropped for want of one."""
    whole = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    return resolved.groupBy("pathway_id").agg(F.count_if(whole).alias("n_edges"), F.count_if(~whole).alias("n_dropped"))


def with_linked(rows: DataFrame, key: str, links: DataFrame, others: DataFrame, other_key: str, project: DataFrame) -> DataFrame:
    """Rows with `linked`, the other table's rows that they are linked with, sorted; only those that the project holds (a table with `other_key`)."""
    inside = links.join(project.select(other_key).distinct(), other_key, "left_semi").join(others, other_key)
    fields = [other_key, *[c for c in others.columns if c != other_key]]
    lists = inside.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("linked"))
    return rows.join(lists, key, "left").withColumn("linked", F.coalesce("linked", F.array()))


def scope(*ids: DataFrame) -> DataFrame:
    """All ids of several tables, each once: what has to be worked out again."""
    out = ids[0]
    for other in ids[1:]:
        out = out.union(other)
    return out.where(F.col(out.columns[0]).isNotNull()).distinct()
