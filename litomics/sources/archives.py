"""Datasets and samples of public archives, from the JSON and XML that their services return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from .rows import ROW_INDEX, placed

# Names of file places, the first that a file has counts; and of what marks phosphorylation.
FTP, ASPERA = "PRIDE:0000469", "PRIDE:0000468"
PHOSPHO = "UNIMOD:21"

_text = lambda c: F.coalesce(c, F.lit(""))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, uid, entry) of summary files: `result` has an object for each uid, and `uids` their order. What is no object is skipped."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "result map<string,string>").alias("v"))
    order = F.from_json(F.try_element_at("v.result", F.lit("uids")), "array<string>")
    each = raw.select("file", order.alias("uids"), F.explode("v.result").alias("uid", "entry")).where((F.col("uid") != "uids") & F.col("entry").startswith("{"))
    return each.select("file", F.array_position(F.coalesce("uids", F.array().cast("array<string>")), F.col("uid")).alias("position"), "uid", "entry")


SERIES = "title string, summary string, organism string, taxon string, n_samples string, gpl string, gse string, accession string, bioproject string, pubmed_ids array<string>"


def series_datasets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Datasets of an expression archive's summaries, and their links with papers (accession, pmid).

    The series is the first of its list, else the accession; a project's id, the first of its list, stands in for it where there is one, so that records of one study meet. Entries without either are skipped, as
    are those that cannot be read. Numbers of samples come as numbers or texts; what is no number is null."""
    one = lambda c: F.trim(F.split_part(_text(c), F.lit(";"), F.lit(1)))
    e = summaries(spark, path).withColumn("e", F.from_json("entry", SERIES)).where("e is not null")
    own, project = one(F.coalesce("e.gse", "e.accession")), _text(F.col("e.bioproject"))
    kinds = C.omic_types(F.concat_ws(" ", _text(F.col("e.title")), _text(F.col("e.summary"))))
    rows = e.select(
        F.when(project != "", one(project)).otherwise(own).alias("accession"), F.lit("geo").alias("source_db"), project.alias("bioproject_id"), _text(F.col("e.title")).alias("title"), _text(F.col("e.summary")).alias("summary"),
        F.array_join(kinds, ",").alias("omic_type"), _text(F.col("e.organism")).alias("organism"), F.col("e.taxon").try_cast("int").alias("tax_id"), F.col("e.n_samples").try_cast("int").alias("n_samples"), _text(F.col("e.gpl")).alias("platform"),
        F.create_map(F.lit("gds_uid"), F.col("uid"), F.lit("gse"), own, F.lit("gpl"), _text(F.col("e.gpl")), F.lit("bioproject"), project).alias("extra_metadata"), F.col("e.pubmed_ids").alias("pubmed_ids"), own.alias("_own"),
    ).where("_own <> ''")
    links = rows.select("accession", F.explode("pubmed_ids").alias("p")).select("accession", F.col("p").try_cast("long").alias("pmid")).where("pmid is not null")
    return rows.drop("pubmed_ids", "_own"), links


EXPERIMENT = """Summary struct<Title: string, Platform: struct<_VALUE: string, _instrument_model: string>, Statistics: struct<_total_runs: string>>, Study struct<_acc: string, _name: string>,
 Organism struct<_taxid: string, _ScientificName: string>, Library_descriptor struct<LIBRARY_STRATEGY: string>, Bioproject string"""


def sequence_datasets(spark: SparkSession, path: str) -> DataFrame:
    """One dataset for each study of a sequence archive's summaries.

    The longest title, the first of equally long ones, and the most runs where the first experiment tells them; all else is of the study's first experiment. The omic type is the
    first that holds. Experiments without a study, or whose XML can't be read, are skipped."""
    e = summaries(spark, path).withColumn("e", F.from_json("entry", "expxml string, createdate string"))
    x = e.withColumn("x", F.from_xml(F.concat(F.lit("<root>"), "e.expxml", F.lit("</root>")), EXPERIMENT)).where(_text(F.col("x.Study._acc")) != "")
    title, strategy = F.trim(_text(F.col("x.Summary.Title"))), F.trim(_text(F.col("x.Library_descriptor.LIBRARY_STRATEGY")))
    rows = x.select(
        F.col("x.Study._acc").alias("accession"), F.struct("file", "position", "uid").alias("seq"), title.alias("title"), F.when(title != "", title).otherwise(_text(F.col("x.Study._name"))).alias("first_title"),
        F.col("x.Summary.Statistics._total_runs").try_cast("int").alias("n_runs"), _text(F.col("x.Bioproject")).alias("bioproject_id"), _text(F.col("x.Organism._ScientificName")).alias("organism"),
        F.col("x.Organism._taxid").try_cast("int").alias("tax_id"), F.coalesce(F.nullif("x.Summary.Platform._instrument_model", F.lit("")), F.lit("")).alias("platform"), strategy.alias("omic_subcategory"),
        F.get(C.omic_types(F.concat_ws(" ", title, _text(F.col("x.Study._name")), strategy)), F.lit(0)).alias("omic_type"), F.col("e.createdate").alias("createdate"),
    )
    kept = ["first_title", "n_runs", "bioproject_id", "organism", "tax_id", "platform", "omic_subcategory", "omic_type", "createdate"]
    one = rows.groupBy("accession").agg(F.min_by(F.struct(*kept), "seq").alias("f"), F.min(F.struct((-F.octet_length("title")).alias("n"), "seq", "title")).alias("t"), F.max("n_runs").alias("most_runs"))
    longest = F.when(-F.col("t.n") > F.octet_length("f.first_title"), F.col("t.title")).otherwise(F.col("f.first_title"))
    return one.select("accession", longest.alias("title"), F.when(F.col("f.n_runs").isNotNull(), F.col("most_runs")).alias("n_samples"), *[f"f.{c}" for c in kept[2:]])


BIOPROJECT = """project_acc string, project_title string, description_name string, description_title string, organism_name string, organism_taxid string, target_scope string, target_material string,
 method_type string, biosample_count string, pubmed_ids array<string>"""


def projects(spark: SparkSession, path: str) -> DataFrame:
    """accession, title, summary, omic_type, organism, tax_id, n_samples, pmids of project summaries; numbers that can't be read are null."""
    p = summaries(spark, path).select(F.from_json("entry", BIOPROJECT).alias("p")).where(_text(F.col("p.project_acc")) != "")
    summary = F.coalesce("p.description_title", "p.description_name", F.lit(""))
    hint = F.concat_ws(" ", _text(F.col("p.project_title")), summary, _text(F.col("p.method_type")), _text(F.col("p.target_material")))
    return p.select(
        F.col("p.project_acc").alias("accession"), _text(F.col("p.project_title")).alias("title"), summary.alias("summary"), F.array_join(C.omic_types(hint), ",").alias("omic_type"),
        _text(F.col("p.organism_name")).alias("organism"), F.col("p.organism_taxid").try_cast("int").alias("tax_id"), F.col("p.biosample_count").try_cast("int").alias("n_samples"),
        F.array_compact(F.transform(F.coalesce("p.pubmed_ids", F.array().cast("array<string>")), lambda x: x.try_cast("long"))).alias("pmids"),
    )


STUDY = """accessionId: string, publicationInfo: struct<pubmedId: string, title: string>, diseaseTrait: struct<`trait`: string>, associationCount: long, initialSampleSize: string,
 platforms: array<struct<manufacturer: string>>, genotypingTechnologies: array<struct<genotypingTechnology: string>>"""


def association_studies(spark: SparkSession, path: str) -> DataFrame:
    """Studies of an association catalogue: those with an accession, each once; the trait stands in for a missing title."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"_embedded struct<studies: array<struct<{STUDY}>>>").alias("v"))
    s = raw.select(F.explode("v._embedded.studies").alias("s")).where(_text(F.col("s.accessionId")) != "")
    trait = _text(F.col("s.diseaseTrait.trait"))
    rows = s.select(
        F.col("s.accessionId").alias("accession"), F.coalesce(F.nullif("s.publicationInfo.title", F.lit("")), trait).alias("title"), trait.alias("summary"), F.lit("genomic").alias("omic_type"),
        F.lit("GWAS Array").alias("omic_subcategory"), F.lit("Homo sapiens").alias("organism"), F.lit(9606).alias("tax_id"), _text(F.get("s.platforms", F.lit(0))["manufacturer"]).alias("platform"),
        _text(F.get("s.genotypingTechnologies", F.lit(0))["genotypingTechnology"]).alias("genotyping_technology"), F.col("s.associationCount").alias("association_count"),
        F.col("s.initialSampleSize").alias("sample_size"), F.col("s.publicationInfo.pubmedId").try_cast("long").alias("pmid"),
    )
    return rows.dropDuplicates(["accession"])


FILES = "array<struct<fileName: string, fileCategory: struct<value: string>, publicFileLocations: array<struct<accession: string, value: string>>>>"
TERM = "array<struct<accession: string, cvLabel: string, name: string>>"
PROJECT = f"""accession string, title string, projectDescription string, sampleProcessingProtocol string, submissionType string, doi string, keywords array<string>, organisms {TERM}, organismParts {TERM},
 diseases {TERM}, identifiedPTMStrings {TERM}, instruments {TERM}, `references` array<struct<pubmedId: string, doi: string>>, files {FILES}"""


def file_url(places: Column) -> Column:
    """The address of a file: by FTP, else Aspera, else the first there is; null where there is none."""
    at = lambda test: F.try_element_at(F.transform(F.filter(places, test), lambda x: x["value"]), F.lit(1))
    named = lambda name: F.nullif(at(lambda x: x["accession"] == name), F.lit(""))
    return F.coalesce(named(FTP), named(ASPERA), at(lambda x: _text(x["value"]) != ""))


def matrix_pointer(files: Column, submission: Column) -> Column:
    """Of a complete submission the result file of the best format, the first of equals; of others the first raw file by name. Files without an address don't count."""
    rank = lambda name: F.when(name.rlike(r"\.mztab(\.gz)?$"), 3).when(name.rlike(r"\.(mzidentml|mzid|mzid\.gz)$"), 2).otherwise(1)
    of = lambda kind: F.filter(F.transform(files, lambda f, i: F.struct((-rank(F.lower(_text(f["fileName"])))).alias("rank"), i.alias("i"), _text(f["fileName"]).alias("name"), file_url(f["publicFileLocations"]).alias("url"), _text(f["fileCategory"]["value"]).alias("kind"))), lambda x: (x["kind"] == kind) & x["url"].isNotNull())
    result = F.array_min(F.transform(of("RESULT"), lambda x: F.struct(x["rank"].alias("a"), x["i"].alias("b"), x["url"].alias("url"))))
    raw = F.array_min(F.transform(of("RAW"), lambda x: F.struct(x["name"].alias("a"), x["i"].alias("b"), x["url"].alias("url"))))
    return F.when(submission == "COMPLETE", result["url"]).otherwise(raw["url"])


def is_phospho(terms: Column) -> Column:
    return F.coalesce(F.exists(terms, lambda x: F.contains(F.lower(_text(x["name"])), F.lit("phospho")) | (F.coalesce(x["accession"], x["cvLabel"], F.lit("")) == PHOSPHO)), F.lit(False))


def proteomics_projects(spark: SparkSession, path: str) -> DataFrame:
    """Projects of a proteomics archive, JSON lines of a project with its `files`: data_format, and a `contract` with pointer, modality, raw terms and references."""
    p = spark.read.schema(PROJECT).json(path).where(_text(F.col("accession")) != "")
    submission = F.upper(F.coalesce("submissionType", F.lit("PARTIAL")))
    names = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast(TERM)), lambda x: x["name"]), lambda x: _text(x) != "")
    refs = F.coalesce(F.col("references"), F.array().cast("array<struct<pubmedId: string, doi: string>>"))
    pmids = F.filter(F.transform(refs, lambda r: r["pubmedId"].try_cast("long")), lambda x: x > 0)
    dois = F.filter(F.transform(refs, lambda r: r["doi"]), lambda x: _text(x) != "")
    own = F.when((_text(F.col("doi")) != "") & ~F.array_contains(dois, F.col("doi")), F.array("doi")).otherwise(F.array().cast("array<string>"))
    contract = F.struct(
        matrix_pointer(F.coalesce("files", F.array().cast(FILES)), submission).alias("matrix_pointer"), F.when(is_phospho(F.col("identifiedPTMStrings")), "phospho").otherwise("global").alias("proteomics_modality"),
        names(F.col("organismParts")).alias("tissue_raw"), names(F.col("diseases")).alias("disease_raw"), pmids.alias("ref_pmids"), F.concat(dois, own).alias("ref_dois"), F.col("accession").alias("proteomexchange_acc"),
    )
    newt = F.filter(F.coalesce("organisms", F.array().cast(TERM)), lambda x: x["accession"].rlike("^(NEWT:)?[0-9]+$"))
    return p.select(
        "accession", F.coalesce("title", "accession").alias("title"), F.coalesce("projectDescription", "sampleProcessingProtocol", F.lit("")).alias("summary"), F.lit("proteomic").alias("omic_type"),
        _text(F.get(names(F.col("organisms")), F.lit(0))).alias("organism"), F.regexp_extract(_text(F.get(newt, F.lit(0))["accession"]), "[0-9]+$", 0).try_cast("int").alias("tax_id"),
        F.when(submission == "COMPLETE", "processed").otherwise("raw").alias("data_format"), F.lit("public").alias("access_type"), contract.alias("contract"),
    )


SAMPLE = "_accession string, TITLE string, SAMPLE_NAME struct<SCIENTIFIC_NAME: string, TAXON_ID: string>, SAMPLE_ATTRIBUTES struct<SAMPLE_ATTRIBUTE: array<struct<TAG: string, VALUE: string>>>"


def sequence_samples(spark: SparkSession, path: str) -> DataFrame:
    """accession, title, organism, tax_id, characteristics of a sequence archive's sample XML; each accession once, as it stands first, of equal tags the last counts."""
    raw = placed(spark.read.format("xml").option("rowTag", "SAMPLE").schema(SAMPLE).load(path))
    pairs = F.filter(F.coalesce("SAMPLE_ATTRIBUTES.SAMPLE_ATTRIBUTE", F.array().cast("array<struct<TAG: string, VALUE: string>>")), lambda x: (_text(x["TAG"]) != "") & x["VALUE"].isNotNull())
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_replace(F.lower(F.trim(x["TAG"])), " ", "_").alias("k"), F.trim(x["VALUE"]).alias("v")))
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["k"] == x["k"]))
    rows = raw.select(
        F.trim(_text(F.col("_accession"))).alias("accession"), F.trim(_text(F.col("TITLE"))).alias("title"), F.trim(_text(F.col("SAMPLE_NAME.SCIENTIFIC_NAME"))).alias("organism"),
        F.trim("SAMPLE_NAME.TAXON_ID").try_cast("int").alias("tax_id"), F.map_from_entries(last).alias("characteristics"), F.col(ROW_INDEX).alias("seq"),
    ).where("accession <> ''")
    first = rows.groupBy("accession").agg(F.min_by(F.struct("title", "organism", "tax_id", "characteristics"), "seq").alias("s"))
    return first.select("accession", "s.*")
