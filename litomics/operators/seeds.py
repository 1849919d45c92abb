"""Signed evidence per sample and gene: copy number, mutations, both together, and which version counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import genomics as G
from .upsert import first_per_key

#: Method versions, the strongest first.
PRECEDENCE = ("cnv-v2", "snv-v1", "cnv-v1")


def copy_number_seeds(values: DataFrame, roles: DataFrame, gain: float = 0.3, loss: float = -0.3) -> DataFrame:
    """(sample, gene, direction, magnitude, confidence) of values whose gene's role gives them a direction; others make no row.

    values: sample, gene, value. roles: gene_symbol, role, unique by symbol."""
    r = roles.select(F.upper("gene_symbol").alias("gene"), "role")
    rows = values.withColumn("gene", F.upper("gene")).join(r, "gene").withColumn("direction", G.copy_direction(F.col("role"), F.col("value"), gain, loss))
    return rows.where("direction is not null").select("sample", "gene", "direction", F.abs("value").alias("magnitude"), F.lit(0.6).alias("confidence"), F.lit("").alias("variant_key"), F.lit("cnv-v1").alias("method_version"))


def mutation_seeds(occurrences: DataFrame, roles: DataFrame, resolved: DataFrame) -> DataFrame:
    """Seeds of mutations, one for each (sample, gene, variant).

    Truncating ones are strong and inactivate suppressors only; missense and in-frame ones need a resolved effect, of the
    greatest resolution version; others make no row. occurrences: sample, gene, variant_key, classification, seq."""
    best = first_per_key(resolved, ["variant_key", "gene_symbol"], F.desc("resolution_version")).select("variant_key", F.upper("gene_symbol").alias("gene"), F.col("direction").alias("r_direction"), F.col("magnitude").alias("r_magnitude"), F.col("confidence").alias("r_confidence"))
    r = roles.select(F.upper("gene_symbol").alias("gene"), "role")
    kind = F.lower("classification")
    rows = occurrences.withColumn("gene", F.upper("gene")).join(r, "gene", "left").join(best, ["variant_key", "gene"], "left")
    cut = kind.isin(*G.TRUNCATING)
    missense = kind.isin(*G.MISSENSE) & F.col("r_direction").isNotNull()
    out = rows.where(cut | missense).select(
        "sample", "gene",
        F.when(cut, F.when(F.col("role") == "tsg", "inactivator").otherwise("neutral")).otherwise(F.col("r_direction")).alias("direction"),
        F.when(cut, 0.9).otherwise(F.col("r_magnitude")).alias("magnitude"), F.when(cut, 0.9).otherwise(F.col("r_confidence")).alias("confidence"),
        "variant_key", F.lit("snv-v1").alias("method_version"), "seq",
    )
    return first_per_key(out, ["sample", "gene", "variant_key"], F.asc("seq")).drop("seq")


def allele_seeds(copy: DataFrame, mutations: DataFrame) -> DataFrame:
    """Copy-number seeds judged again with damaging mutations of the same sample and gene.

    A lost suppressor with a damaging mutation is surer; a gained oncogene with one is neutral; alone both keep their direction."""
    damaged = mutations.where((F.col("direction") == "inactivator") | (F.col("magnitude") >= 0.9)).select("sample", F.upper("gene").alias("gene")).distinct().withColumn("hit", F.lit(True))
    rows = copy.withColumn("gene", F.upper("gene")).join(damaged, ["sample", "gene"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    lost, gained = F.col("direction") == "inactivator", F.col("direction") == "activator"
    return rows.select(
        "sample", "gene",
        F.when(lost, "inactivator").when(gained & ~F.col("hit"), "activator").otherwise("neutral").alias("direction"),
        F.when(lost & F.col("hit"), F.greatest("magnitude", F.lit(0.9))).otherwise(F.col("magnitude")).alias("magnitude"),
        F.when(lost & F.col("hit"), 0.95).when(lost, 0.60).when(gained & F.col("hit"), 0.40).when(gained, 0.70).otherwise(0.60).alias("confidence"),
        F.lit("").alias("variant_key"), F.lit("cnv-v2").alias("method_version"),
    )


def resolve_effects(raw: DataFrame, roles: DataFrame, underscores: bool = False) -> DataFrame:
    """One effect for each (variant, gene): ClinVar if it decides, else AlphaMissense, else dbNSFP; magnitudes within 0 and 1.

    raw: variant_key, gene_symbol, source, oncogenicity, clinvar_significance, raw_magnitude."""
    m = F.when(F.col("source") == "clinvar", G.clinvar_magnitude(F.col("oncogenicity"), F.col("clinvar_significance"), underscores)).otherwise(F.col("raw_magnitude"))
    per = raw.withColumn("m", m).groupBy("variant_key", "gene_symbol").agg(*[F.max(F.when(F.col("source") == s, F.col("m"))).alias(s) for s in G.CONFIDENCE])
    source = F.coalesce(*[F.when(F.col(s).isNotNull(), s) for s in G.CONFIDENCE])
    out = per.withColumn("source", source).where("source is not null").withColumn("magnitude", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(*G.CONFIDENCE))))
    confidence = F.when(F.col("source") == "clinvar", 0.9).when(F.col("source") == "alphamissense", 0.7).otherwise(0.6)
    r = roles.select(F.upper("gene_symbol").alias("g"), "role")
    named = out.join(r, F.upper("gene_symbol") == F.col("g"), "left").withColumn("role", F.coalesce("role", F.lit("unknown")))
    return named.select(
        "variant_key", "gene_symbol", "source", "magnitude", confidence.alias("confidence"), G.effect_class(F.col("magnitude")).alias("effect_class"),
        G.effect_direction(F.col("magnitude"), F.col("role")).alias("direction"), ((F.col("role") == "oncogene_and_tsg") & (F.col("magnitude") >= G.DAMAGING)).alias("dual"),
    )


def effective(seeds: DataFrame) -> DataFrame:
    """One signed weight for each (sample, gene): the seed of the strongest version, ties by weight and variant.

    A neutral winner gives weight 0 and `masked` when it hides a directed seed of a weaker version."""
    rank = F.lit(len(PRECEDENCE))
    for i, v in reversed(list(enumerate(PRECEDENCE))):
        rank = F.when(F.col("method_version") == v, i).otherwise(rank)
    rows = seeds.withColumn("gene", F.upper("gene")).withColumn("rank", rank)
    own = Window.partitionBy("sample", "gene")
    order = own.orderBy("rank", F.desc(F.abs(F.col("magnitude") * F.col("confidence"))), "variant_key")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("n_directed", F.count_if(F.col("direction") != "neutral").over(own))
    sign = F.when(F.col("direction") == "activator", 1.0).when(F.col("direction") == "inactivator", -1.0).otherwise(0.0)
    return rows.where("n = 1").select("sample", "gene", "method_version", "direction", (sign * F.col("magnitude") * F.col("confidence")).alias("weight"), ((F.col("direction") == "neutral") & (F.col("method_version") == PRECEDENCE[0]) & (F.col("n_directed") > 0)).alias("masked"))
