"""Header-driven text tables: columns are found by name, whatever their order; extra columns are left aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genomics as G
from .block_gzip import lines as lines_of_file
from .rows import ROW_INDEX, first_rows, numbered


def read_tsv(spark: SparkSession, path: str, sep: str = "\t", comment: str | None = None) -> DataFrame:
    """A table with a header, all columns text. Quotes are no syntax in tab tables. Tab tables in gzip are read by blocks where they have them."""
    if sep == "\t" and path.endswith((".gz", ".bgz")):
        every = lines_of_file(spark, path).where(F.col("value") != "")
        every = every.where(~F.col("value").startswith(comment)) if comment else every
        head = every.first()
        if head is None:
            raise ValueError(f"no header in {path}")
        f = F.split("value", "\t")
        return every.where(F.col("value") != head["value"]).select(*[F.nullif(F.get(f, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(head["value"].split("\t"))])
    reader = spark.read.option("header", True).option("sep", sep).option("quote", "" if sep == "\t" else '"').option("inferSchema", False)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def column(rows: DataFrame, *names: str, part: bool = False) -> Column:
    """The first column with one of the names (or, with `part`, with a name that holds one), letter case ignored; null if there is none."""
    for n in names:
        for c in rows.columns:
            if (n.lower() in c.lower()) if part else (c.strip().lower() == n.lower()):
                return F.col(f"`{c}`")
    return F.lit(None).cast("string")


def required(rows: DataFrame, *names: str) -> None:
    have = {c.strip().lower() for c in rows.columns}
    if missing := [n for n in names if n.lower() not in have]:
        raise ValueError(f"columns missing: {', '.join(missing)}")


def number(c: Column) -> Column:
    """A double; null for blanks, NA, NaN, null and a dot."""
    text = F.lower(F.trim(c))
    return F.when(text.isin("", "na", "nan", "null", "."), None).otherwise(text).try_cast("double")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A wide matrix (feature, one float column for each sample, row_index) of a tab table whose first column names the feature; blank features go.

    row_index numbers the file's rows in order, so that repeated features keep their order whatever the number of tasks. Every row stays."""
    rows = numbered(read_tsv(spark, path))
    first, *samples = rows.columns[:-1]
    feature = F.trim(F.col(f"`{first}`"))
    return rows.where(feature != "").select(feature.alias("feature"), *[number(F.col(f"`{c}`")).cast("float").alias(c) for c in samples], ROW_INDEX)


def last_of_feature(wide: DataFrame) -> DataFrame:
    """(feature, v): of a repeated feature the last row, whole. Without row_index features have to be unique."""
    values = F.struct(*[c for c in wide.columns if c not in ("feature", ROW_INDEX)])
    return wide.groupBy("feature").agg(F.max_by(values, ROW_INDEX).alias("v")) if ROW_INDEX in wide.columns else wide.select("feature", values.alias("v"))


def paired_matrix(tumor: DataFrame, normal: DataFrame) -> DataFrame:
    """Features of both matrices with T_ and N_ columns, in order of the feature; of a repeated feature the row with the largest row_index stays."""

    def one(m: DataFrame, prefix: str) -> DataFrame:
        return last_of_feature(m).select("feature", *[F.col(f"v.`{c}`").alias(f"{prefix}{c}") for c in m.columns if c not in ("feature", ROW_INDEX)])

    return one(tumor, "T_").join(one(normal, "N_"), "feature").orderBy("feature")


def gene_roles(spark: SparkSession, path: str, version: str) -> DataFrame:
    """gene_symbol, entrez_id, role, is_census, is_vogelstein, source_version of a cancer gene list."""
    rows = read_tsv(spark, path)
    required(rows, "Hugo Symbol", "Gene Type")
    yes = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))) == "yes"
    symbol = F.upper(F.trim(column(rows, "Hugo Symbol")))
    return rows.where(symbol != "").select(
        symbol.alias("gene_symbol"), column(rows, "Entrez Gene ID").try_cast("long").alias("entrez_id"), G.gene_role(column(rows, "Gene Type")).alias("role"),
        yes(column(rows, "CGC", part=True)).alias("is_census"), yes(column(rows, "Vogelstein")).alias("is_vogelstein"), F.lit(version).alias("source_version"),
    )


def clinvar(spark: SparkSession, path: str, genes: DataFrame | None = None) -> DataFrame:
    """variant_key, gene_symbol, clinvar_significance, oncogenicity of a VCF (gzip or plain).

    Lines with fewer than 8 fields, several or spanning alleles, or no gene go; with `genes` (gene_symbol) only theirs stay."""
    f = F.split(F.col("value"), "\t")
    lines = lines_of_file(spark, path).where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.size("f") >= 8)
    at = lambda i: F.col("f")[i]
    info = at(7)
    out = lines.select(
        G.variant_key(at(0), at(1), at(3), at(4)).alias("variant_key"), G.first_gene(G.info_value(info, "GENEINFO")).alias("gene_symbol"),
        F.coalesce(G.info_value(info, "CLNSIG"), F.lit("")).alias("clinvar_significance"),
        F.coalesce(G.info_value(info, "ONC"), G.info_value(info, "ONCDN"), G.info_value(info, "SCI"), F.lit("")).alias("oncogenicity"),
    ).where("variant_key is not null and gene_symbol is not null")
    return out if genes is None else out.join(genes.select("gene_symbol").distinct(), "gene_symbol", "left_semi")


def alphamissense(spark: SparkSession, path: str, proteins: DataFrame, genes: DataFrame) -> DataFrame:
    """variant_key, gene_symbol, raw_magnitude, raw_class of a pathogenicity table with a preamble of comments.

    proteins: uniprot_id, gene_symbol; genes: gene_symbol. Both are joins; the source is large, they are not, and Spark sees that."""
    f = F.split(F.col("value"), "\t")
    lines = lines_of_file(spark, path).where(~F.col("value").rlike(r"^#(?!CHROM)")).select(f.alias("f"))
    header = [c.lstrip("#").lower() for c in lines.where(F.upper(F.regexp_replace(F.col("f")[0], "^#", "")) == "CHROM").first()["f"]]
    at = lambda name: F.get(F.col("f"), F.lit(header.index(name)))
    rows = lines.where(F.upper(F.regexp_replace(F.col("f")[0], "^#", "")) != "CHROM").select(
        G.variant_key(at("chrom"), at("pos"), at("ref"), at("alt")).alias("variant_key"), at("uniprot_id").alias("uniprot_id"), number(at("am_pathogenicity")).alias("raw_magnitude"), at("am_class").alias("raw_class")
    )
    named = rows.where("variant_key is not null and raw_magnitude is not null and uniprot_id <> ''").join(proteins.select("uniprot_id", F.upper("gene_symbol").alias("gene_symbol")).distinct(), "uniprot_id")
    return named.join(genes.select(F.upper("gene_symbol").alias("gene_symbol")).distinct(), "gene_symbol", "left_semi").select("variant_key", "gene_symbol", "raw_magnitude", "raw_class")


def mutations(spark: SparkSession, path: str, sample: str, genes: DataFrame) -> DataFrame:
    """sample, gene, variant_key, classification of a mutation table (MAF): listed genes first, then non-synonymous classes."""
    rows = read_tsv(spark, path, comment="#")
    required(rows, "Hugo_Symbol", "Chromosome", "Start_Position", "Variant_Classification", "Reference_Allele", "Tumor_Seq_Allele2")
    allele = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^-$", "")
    out = rows.select(
        F.lit(sample).alias("sample"), F.upper(F.trim(column(rows, "Hugo_Symbol"))).alias("gene"),
        F.concat_ws(":", F.regexp_replace(column(rows, "Chromosome"), "(?i)^chr", ""), column(rows, "Start_Position"), allele(column(rows, "Reference_Allele")), allele(column(rows, "Tumor_Seq_Allele2"))).alias("variant_key"),
        column(rows, "Variant_Classification").alias("classification"),
    )
    listed = out.join(genes.select(F.upper("gene_symbol").alias("gene")).distinct(), "gene", "left_semi")
    return listed.where(F.lower("classification").isin(*G.NONSYNONYMOUS)).select("sample", "gene", "variant_key", "classification")


def regulons(spark: SparkSession, path: str, factors: DataFrame | None = None) -> DataFrame:
    """tf, target, sign, n_references of an interaction table; with `factors` (symbol) only theirs."""
    rows = read_tsv(spark, path)
    refs = F.size(F.filter(F.split(F.coalesce(column(rows, "references"), F.lit("")), ";"), lambda x: F.trim(x) != ""))
    out = rows.select(
        F.upper(column(rows, "source_genesymbol", "source")).alias("tf"), F.upper(column(rows, "target_genesymbol", "target")).alias("target"),
        G.regulon_sign(column(rows, "is_stimulation"), column(rows, "is_inhibition")).alias("sign"), refs.alias("n_references"),
    )
    return out if factors is None else out.join(factors.select(F.upper("symbol").alias("tf")).distinct(), "tf", "left_semi")


def run_files(spark: SparkSession, path: str, key: str = "run_accession") -> DataFrame:
    """One row for each file of an archive's run report: parallel lists of links, digests and sizes, counted from 1."""
    rows = read_tsv(spark, path)
    lists = lambda name: F.split(F.coalesce(F.nullif(F.trim(column(rows, name)), F.lit("-")), F.lit("")), ";")
    listed = rows.select(column(rows, key).alias("run"), lists("fastq_ftp").alias("url"), lists("fastq_md5").alias("md5"), lists("fastq_bytes").alias("size"))
    out = listed.select("run", F.posexplode(F.arrays_zip("url", "md5", "size")).alias("at", "z"))
    url, md5, size = (F.col(f"z.{c}") for c in ("url", "md5", "size"))
    return out.where(F.coalesce(url, F.lit("")) != "").select(
        F.concat_ws("_", "run", (F.col("at") + 1).cast("string")).alias("accession"), "run", F.concat(F.lit("https://"), F.regexp_replace(url, "^(ftp|https?)://", "")).alias("url"), F.lower(F.nullif(md5, F.lit(""))).alias("md5"), size.try_cast("long").alias("size_bytes")
    )


def trait_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed names of the first column that speaks of a disease or trait."""
    rows = read_tsv(spark, path)
    name = next(c for c in rows.columns if "disease" in c.lower() or "trait" in c.lower())
    return rows.select(F.trim(F.col(f"`{name}`")).alias("name")).where("name <> ''").distinct()


# Confidences; anything else is unknown.
CONFIDENCES = ("definitive", "strong", "moderate", "limited")


def gene_disease(spark: SparkSession, path: str, raw_too: bool = False) -> DataFrame:
    """disease, gene_symbol, hgnc_id, confidence of a gene-disease CSV, with `raw_too` confidence_raw as it stands; of repeated (gene, disease) the first row of the file counts, whole."""
    rows = numbered(read_tsv(spark, path, sep=","))
    required(rows, "gene symbol", "disease name", "confidence")
    plain = lambda *names: F.trim(F.coalesce(column(rows, *names), F.lit("")))
    hgnc, raw = plain("hgnc id"), plain("confidence")
    out = rows.select(
        plain("disease name").alias("disease"), F.upper(plain("gene symbol")).alias("gene_symbol"), F.when((hgnc != "") & ~F.upper(hgnc).startswith("HGNC:"), F.concat(F.lit("HGNC:"), hgnc)).otherwise(hgnc).alias("hgnc_id"),
        F.when(F.lower(raw).isin(*CONFIDENCES), F.lower(raw)).otherwise("unknown").alias("confidence"), raw.alias("confidence_raw"), ROW_INDEX,
    ).where("disease <> '' and gene_symbol <> ''")
    return first_rows(out, "disease", "gene_symbol").drop(ROW_INDEX, *([] if raw_too else ["confidence_raw"]))
