"""Curation steps: manual decisions, categories, suggestions, download targets, join keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def resolve(rows: DataFrame, key: str, decisions: DataFrame) -> DataFrame:
    """Rows with decisions (key, axis, note, user, at) put over them: the axis, a full score marked as manual, the note on a line of its own.

    rows: key, axis, confidence (map), notes."""
    d = decisions.select(key, F.col("axis").alias("new_axis"), F.concat(F.lit("["), F.date_format("at", "yyyy-MM-dd HH:mm"), F.lit(" "), F.col("user"), F.lit("] "), F.col("note")).alias("line"))
    manual = F.create_map(F.lit("score"), F.lit("1.0"), F.lit("manual"), F.lit("true"))
    kept = F.map_filter(F.coalesce("confidence", F.expr("cast(map() as map<string,string>)")), lambda k, v: ~k.isin("score", "manual"))
    out = rows.join(d, key, "left")
    hit = F.col("new_axis").isNotNull()
    return out.withColumns({"axis": F.coalesce("new_axis", "axis"), "confidence": F.when(hit, F.map_concat(kept, manual)).otherwise(F.col("confidence")), "notes": F.when(hit, F.concat_ws("\n", F.nullif("notes", F.lit("")), "line")).otherwise(F.col("notes"))}).drop("new_axis", "line")


def categorise(assigned: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """(paper_id, category) after adding and removing; what is in both is removed."""
    return assigned.select("paper_id", "category").union(add.select("paper_id", "category")).distinct().join(remove.select("paper_id", "category"), ["paper_id", "category"], "left_anti")


def accept_suggestion(project_rows: DataFrame, suggested: DataFrame, key: str) -> DataFrame:
    """A project's rows with suggested ids added as pending where they are missing."""
    missing = suggested.select(key).distinct().join(project_rows.select(key), key, "left_anti").withColumn("curation_status", F.lit("pending"))
    return project_rows.select(key, "curation_status").unionByName(missing)


def download_targets(datasets: DataFrame, samples: DataFrame, runs: DataFrame) -> DataFrame:
    """(dataset_id, kind, n_samples): reads for sequence archives and for series with runs, supplementary files for other series; datasets without a sample are left out."""
    n = samples.groupBy("dataset_id").agg(F.count("*").alias("n_samples"))
    with_runs = samples.join(runs.select("sample_id").distinct(), "sample_id", "left_semi").select("dataset_id").distinct().withColumn("has_runs", F.lit(True))
    kind = F.when(F.col("source_db") == "sra", "fastq").when((F.col("source_db") == "geo") & F.coalesce("has_runs", F.lit(False)), "fastq").when(F.col("source_db") == "geo", "supplementary").otherwise("processed")
    return datasets.join(n, "dataset_id").join(with_runs, "dataset_id", "left").select("dataset_id", kind.alias("kind"), "n_samples")


def sample_join_keys(datasets: DataFrame, links: DataFrame) -> DataFrame:
    """(dataset_id, keys, score): normalised ids that join samples of different datasets, and the strongest kind among them.

    A project id scores 0.9, a PubMed id of a link 0.7, a DOI 0.65, an accession in the text alone 0.5."""
    d = datasets.select("dataset_id", F.explode(F.array(
        F.struct(T.bioproject(F.col("bioproject")).alias("k"), F.lit(0.9).alias("s")), F.struct(T.doi(F.col("doi")).alias("k"), F.lit(0.65).alias("s")), F.struct(T.bioproject(F.col("summary")).alias("k"), F.lit(0.5).alias("s")),
    )).alias("x")).select("dataset_id", "x.k", "x.s")
    p = links.select("dataset_id", T.pmid(F.col("pmid")).alias("k"), F.lit(0.7).alias("s"))
    return d.unionByName(p).where("k is not null").groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("keys"), F.max("s").alias("score"))


# Tokens of omic types and the layers they mean.
LAYERS = {
    "genomic": "genomics", "transcriptomic": "transcriptomics", "proteomic": "proteomics", "metabolomic": "metabolomics", "epigenomic": "epigenomics", "microbiome": "microbiomics", "metagenomic": "metagenomics",
}


def omics_layers(omic_type: Column) -> Column:
    """Distinct layers of a comma list of omic types, in its order."""
    tokens = F.transform(F.split(F.lower(F.coalesce(omic_type, F.lit(""))), ","), lambda x: F.trim(x))
    names = F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv])
    return F.array_distinct(F.array_compact(F.transform(tokens, lambda x: F.try_element_at(names, x))))


def run_rows(samples: DataFrame) -> DataFrame:
    """(sample_id, run) of a JSON list of runs, trimmed, without blanks and repeats."""
    runs = F.from_json("sra_runs", "array<string>")
    return samples.select("sample_id", F.explode(runs).alias("run")).select("sample_id", F.trim("run").alias("run")).where("run <> ''").distinct()


def first_of_repeats(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Rows whose id is the least of their natural key."""
    least = rows.groupBy(*keys).agg(F.min(id_).alias(id_))
    return rows.join(least, [*keys, id_], "left_semi")


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of a classification run by its outcome."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
