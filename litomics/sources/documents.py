"""XML, JSON and block-structured sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genomics as G

# Publication types, the first that an article has counts.
PUBLICATION_TYPES = (
    "Meta-Analysis", "Systematic Review", "Randomized Controlled Trial", "Clinical Trial", "Review", "Observational Study", "Case Reports", "Comparative Study", "Multicenter Study", "Editorial", "Journal Article",
)
# Countries looked for in affiliations.
COUNTRIES = "USA|United States|UK|United Kingdom|China|Brazil|Germany|France|Italy|Spain|Japan|Canada|Australia|India|Netherlands|Sweden|Switzerland|South Korea|Portugal|Mexico|Israel|Denmark|Norway|Finland|Belgium|Austria|Poland|Turkey|Iran|Argentina|Chile"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

PUBMED_SCHEMA = """MedlineCitation struct<PMID: struct<_VALUE: string>, Article: struct<Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, Month: string, MedlineDate: string>>>, ArticleTitle: string,
 Abstract: struct<AbstractText: array<struct<_VALUE: string, _Label: string>>>, AuthorList: struct<Author: array<struct<LastName: string, Initials: string, AffiliationInfo: array<struct<Affiliation: string>>>>>,
 PublicationTypeList: struct<PublicationType: array<struct<_VALUE: string>>>>, KeywordList: struct<Keyword: array<struct<_VALUE: string>>>,
 MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_VALUE: string, _MajorTopicYN: string>, QualifierName: array<struct<_VALUE: string, _MajorTopicYN: string>>>>>>,
 PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>"""


def month(text: Column) -> Column:
    """1 to 12 from a number, name or abbreviation; else null."""
    word = F.lower(F.substring(F.trim(text), 1, 3))
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), word)
    as_number = F.trim(text).try_cast("int")
    return F.when(as_number.between(1, 12), as_number).when(named > 0, named.cast("int"))


def country(affiliation: Column) -> Column:
    """The first known country of an affiliation; empty if there is none."""
    return F.regexp_extract(F.coalesce(affiliation, F.lit("")), rf"\b({COUNTRIES})\b", 1)


def publication_type(types: Column) -> Column:
    """The first listed type that the array has, else its first element, else empty."""
    listed = F.filter(F.array(*[F.lit(p) for p in PUBLICATION_TYPES]), lambda p: F.array_contains(types, p))
    return F.coalesce(F.try_element_at(listed, F.lit(1)), F.try_element_at(types, F.lit(1)), F.lit(""))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Papers of a PubMed export with nested authors, keywords, headings and ids."""
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(PUBMED_SCHEMA).load(path)
    a, c = "MedlineCitation.Article", "MedlineCitation"
    values = lambda x: F.transform(F.coalesce(F.col(x), F.array()), lambda v: v["_VALUE"])
    ids = F.coalesce(F.col("PubmedData.ArticleIdList.ArticleId"), F.array())
    by_kind = lambda k: F.try_element_at(F.transform(F.filter(ids, lambda x: x["_IdType"] == k), lambda x: x["_VALUE"]), F.lit(1))
    date = f"{a}.Journal.JournalIssue.PubDate"
    return raw.select(
        F.col(f"{c}.PMID._VALUE").try_cast("long").alias("pmid"), F.col(f"{a}.ArticleTitle").alias("title"), F.col(f"{a}.Journal.Title").alias("journal"),
        F.coalesce(F.col(f"{date}.Year"), F.regexp_extract(F.col(f"{date}.MedlineDate"), "[0-9]{4}", 0)).try_cast("int").alias("year"), month(F.col(f"{date}.Month")).alias("month"),
        F.array_join(F.transform(F.coalesce(F.col(f"{a}.Abstract.AbstractText"), F.array()), lambda x: F.when(F.coalesce(x["_Label"], F.lit("")) != "", F.concat(x["_Label"], F.lit(": "), x["_VALUE"])).otherwise(x["_VALUE"])), " ").alias("abstract"),
        F.transform(F.coalesce(F.col(f"{a}.AuthorList.Author"), F.array()), lambda x, i: F.struct(i.alias("position"), x["LastName"].alias("last_name"), x["Initials"].alias("initials"), F.coalesce(F.get(x["AffiliationInfo"], F.lit(0))["Affiliation"], F.lit("")).alias("affiliation"))).alias("authors"),
        publication_type(values(f"{a}.PublicationTypeList.PublicationType")).alias("pub_type"), values(f"{c}.KeywordList.Keyword").alias("keywords"),
        F.transform(F.coalesce(F.col(f"{c}.MeshHeadingList.MeshHeading"), F.array()), lambda m: F.struct(m["DescriptorName"]["_VALUE"].alias("descriptor"), (m["DescriptorName"]["_MajorTopicYN"] == "Y").alias("is_major"), F.transform(F.coalesce(m["QualifierName"], F.array()), lambda q: q["_VALUE"]).alias("qualifiers"))).alias("mesh"),
        by_kind("doi").alias("doi"), by_kind("pmc").alias("pmc_id"),
    ).withColumn("country", country(F.get(F.col("authors"), F.lit(0))["affiliation"]))


PATHWAY_SCHEMA = """_name string, _title string, entry array<struct<_id: string, _name: string, _type: string, graphics: struct<_name: string>>>,
 relation array<struct<_entry1: string, _entry2: string, _type: string, subtype: array<struct<_name: string, _value: string>>>>"""
NODE_TYPES = ("gene", "ortholog", "compound", "map", "group", "enzyme", "reaction", "brite", "other")


def pathways(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of pathway files. A gene's symbol is the first of its names; unknown node types are genes; edges are signed."""
    raw = spark.read.format("xml").option("rowTag", "pathway").schema(PATHWAY_SCHEMA).load(path).withColumn("pathway_id", F.regexp_replace("_name", "^path:", ""))
    e = raw.select("pathway_id", F.posexplode("entry").alias("seq", "e"))
    kind = F.when(F.col("e._type").isin(*NODE_TYPES), F.col("e._type")).otherwise("gene")
    symbol = F.upper(F.trim(F.split_part(F.split_part(F.coalesce("e.graphics._name", F.lit("")), F.lit(","), F.lit(1)), F.lit("..."), F.lit(1))))
    nodes = e.select("pathway_id", "seq", F.col("e._id").alias("entry_id"), kind.alias("node_type"), F.when(kind.isin("gene", "ortholog"), symbol).otherwise("").alias("gene_symbol"))
    r = raw.select("pathway_id", F.posexplode("relation").alias("seq", "r"))
    names = F.transform(F.coalesce("r.subtype", F.array()), lambda s: s["_name"])
    edges = r.select("pathway_id", "seq", F.col("r._entry1").alias("source"), F.col("r._entry2").alias("target"), F.coalesce("r._type", F.lit("maplink")).alias("relation"), names.alias("subtypes"), G.edge_sign(names).alias("sign"))
    return nodes, edges


def soft_samples(spark: SparkSession, path: str) -> DataFrame:
    """accession, title, organism, characteristics (map) of the sample blocks of a SOFT file.

    A characteristic is `key: value`; one without a key is named characteristic_<n>, counted from 1 over all."""
    block = spark.read.option("lineSep", "^SAMPLE").text(path).where(F.col("value").rlike(r"^\s*=")).select(F.split("value", r"\r?\n").alias("lines"))
    first = lambda key: F.try_element_at(F.transform(F.filter("lines", lambda x: x.startswith(f"!Sample_{key} =")), lambda x: F.trim(F.split_part(x, F.lit(" = "), F.lit(2)))), F.lit(1))
    marks = F.transform(F.filter("lines", lambda x: x.rlike(r"^!Sample_characteristics_ch[0-9]+ =")), lambda x: F.trim(F.regexp_replace(x, r"^!Sample_characteristics_ch[0-9]+ =\s*", "")))
    pairs = F.transform(marks, lambda x, i: F.when(x.contains(":"), F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))).otherwise(F.struct(F.concat(F.lit("characteristic_"), (i + 1).cast("string")).alias("k"), x.alias("v"))))
    return block.select(F.trim(F.regexp_replace(F.get("lines", F.lit(0)), r"^\s*=", "")).alias("accession"), first("title").alias("title"), first("organism_ch1").alias("organism"), F.map_from_entries(pairs).alias("characteristics"))


def series_summaries(spark: SparkSession, path: str) -> DataFrame:
    """accession, title, summary, organism, n_samples of JSON lines of series; a project id stands in for the accession, the first of a list counts."""
    rows = spark.read.schema("accession string, bioproject string, gse string, title string, summary string, taxon string, n_samples string").json(path)
    one = lambda c: F.nullif(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(1))), F.lit(""))
    gse = F.when(one(F.col("gse")).startswith("GSE"), one(F.col("gse"))).otherwise(F.concat(F.lit("GSE"), one(F.col("gse"))))
    return rows.select(F.coalesce(one(F.col("bioproject")), gse, one(F.col("accession"))).alias("accession"), "title", "summary", F.col("taxon").alias("organism"), F.col("n_samples").try_cast("int").alias("n_samples")).where("accession is not null")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """File names of a directory listing in HTML, percent-decoded, parents and sorting links left out."""
    text = spark.read.option("wholetext", True).text(path)
    names = F.explode(F.regexp_extract_all("value", F.lit(r"""(?i)href=["']([^"'?]+)["']"""), F.lit(1)))
    return text.select(names.alias("name")).where(~F.col("name").rlike(r"^(\.\.|/|https?:)|/$")).select(F.url_decode("name").alias("name")).distinct()


def disorders(spark: SparkSession, path: str) -> DataFrame:
    """disease, gene_symbol, confidence of a rare-disease XML: assessed where an association names its validation."""
    schema = "Name struct<_VALUE: string>, DisorderGeneAssociationList struct<DisorderGeneAssociation: array<struct<SourceOfValidation: string, Gene: struct<Symbol: string>>>>"
    raw = spark.read.format("xml").option("rowTag", "Disorder").schema(schema).load(path)
    a = raw.select(F.col("Name._VALUE").alias("disease"), F.explode("DisorderGeneAssociationList.DisorderGeneAssociation").alias("a"))
    return a.select("disease", F.upper("a.Gene.Symbol").alias("gene_symbol"), F.when(F.coalesce("a.SourceOfValidation", F.lit("")) != "", "assessed").otherwise("not_assessed").alias("confidence")).where("gene_symbol is not null")
