"""Rule classifiers on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of omic types, several may hold.
OMIC_TYPES = {
    "epigenomic": r"chip.?seq|histone|atac.?seq|bisulfite|methylat|dnase.?seq|faire.?seq",
    "microbiome": r"\b16s\b|microbiom|amplicon.?seq|gut.?flora|oral.?microb|skin.?microb",
    "metagenomic": r"metagenom|shotgun.*microb|whole.?metagenom",
    "metabolomic": r"metabolom|metabolite|nmr.?spectro|lc.?ms.*metabol|gc.?ms.*metabol",
    "proteomic": r"proteom|mass.?spec.*protein|2d.?gel|proteogenom|phosphoproteom",
    "transcriptomic": r"rna.?seq|transcriptom|mrna.?express|gene.?express|microarray|affymetrix|illumina.*rna|scrna|single.?cell.*rna",
    "genomic": r"whole.?genome|wgs|snp.?array|gwas|variant.?call|exome|wes|\bsnp\b|genome.?wide",
    "multi_omic": r"multi.?om|integrat.*omic|multi.?modal.*omic",
}
# Clinical categories with their scores.
CLINICAL = {
    "diagnosis": (r"\b(diagnos|biomarker|detect)\b", 0.8),
    "treatment": (r"\b(therap|treat|drug)\b", 0.8),
    "epidemiology": (r"\b(prevalence|incidence|epidemiolog)\b", 0.9),
    "mechanism": (r"\b(pathophysiolog|mechanism|pathway)\b", 0.8),
    "signs_symptoms": (r"\b(symptom|sign|manifestation)\b", 0.7),
}
# What speaks for and against a control group.
CONTROL = (
    r"\bhealthy\s+control|\bnormal\s+tissue|\bvs\.?\s+control|\bcase[\s\-]control|\bcontrol\s+group|\bhealthy\s+donor|\bundiseased\s+control"
    r"|\bmatched\s+control|\bundiseased\s+tissue|\bnormal\s+adjacent|\bcontrol\s+sample|\bbaseline\s+sample|\buntreated\s+control"
    r"|\bwild[- ]type\s+control|\bhealthy\s+volunteer|\bnon[\s\-]disease|\bno[\s\-]disease|\bdisease[\s\-]free|\bnormal\s+control"
    r"|\bcontrol\s+cohort|\bcase\s+vs\b|\bpatient\s+vs\.|\bcompared\s+to\s+(?:healthy|normal|control)"
)
NO_CONTROL = (
    r"\bquality\s+control|\bpositive\s+control|\bnegative\s+control|\binternal\s+control|\bprocess\s+control|\bcontrol\s+region"
    r"|\bcontrol\s+element|\bvehicle\s+control|\bisotype\s+control"
)
# What speaks for single cells and for bulk.
SINGLE_CELL = (
    r"\bscRNA[\s\-]?seq\b|\bsingle[\s\-]cell\b|\b10x\s+chromium\b|\bChromium\s+10x\b|\bSmart[\s\-]?seq\b|\bDrop[\s\-]?seq\b|\bSEQ[\s\-]?Well\b"
    r"|\bCEL[\s\-]?Seq\b|\bSingle[\s\-]?Cell\s+Proteomics\b|\bSCP\b(?=.*(?:single[\s\-]?cell|proteom))|\bscProteomics\b"
    r"|\bsingle[\s\-]cell\s+sequencing\b|\bsingle[\s\-]cell\s+RNA\b|\bsingle[\s\-]cell\s+ATAC\b|\bsingle[\s\-]cell\s+multi"
    r"|\bspatial\s+transcriptomics?\b|\bspatial\s+single[\s\-]cell\b"
)
BULK = r"\bbulk\s+RNA[\s\-]?seq\b|\bbulk\s+sequencing\b|\bbulk\s+transcriptom|\bmicroarray\b"


def omic_types(text: Column) -> Column:
    """All omic types whose pattern holds, in the rules' order; `other` if none."""
    text = F.coalesce(text, F.lit(""))
    found = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(k)) for k, p in OMIC_TYPES.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def clinical_categories(text: Column) -> Column:
    """array<struct<category, score>> of the clinical patterns that hold."""
    text = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.struct(F.lit(k).alias("category"), F.lit(s).alias("score"))) for k, (p, s) in CLINICAL.items()]))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?im){pattern}"))


def control_group(text: Column) -> Column:
    """struct<value, score>: net matches over all matches and one; `yes` from a half on, else `unknown`."""
    yes, no = _count(text, CONTROL), _count(text, NO_CONTROL)
    score = F.greatest(yes - no, F.lit(0)) / (yes + no + 1)
    return F.struct(F.when(score >= 0.5, "yes").otherwise("unknown").alias("value"), F.round(score, 4).alias("score"))


def single_cell(text: Column) -> Column:
    """struct<value, score>: single_cell, bulk or unknown; more matches raise the score up to a bound."""
    single, bulk = _count(text, SINGLE_CELL), _count(text, BULK)
    value = F.when(single > 0, "single_cell").when(bulk > 0, "bulk").otherwise("unknown")
    score = F.when(single > 0, F.least(0.9 + 0.02 * (single - 1), F.lit(1.0))).when(bulk > 0, F.least(0.75 + 0.05 * (bulk - 1), F.lit(0.95))).otherwise(0.0)
    return F.struct(value.alias("value"), F.round(score, 4).alias("score"))


def access_type(current: Column, source: Column, accession: Column, metadata: Column) -> Column:
    """Where nothing is known yet: public for open archives; for sequence archives controlled on signs of controlled access, else still unknown."""
    s, signs = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(metadata, F.lit("")))
    closed = F.lower(F.coalesce(accession, F.lit(""))).startswith("phs") | signs.rlike("dbgap|phs0|controlled access")
    found = F.when(s.isin("geo", "arrayexpress"), "public").when((s == "sra") & closed, "controlled").otherwise("unknown")
    now = F.coalesce(current, F.lit("unknown"))
    return F.when(now == "unknown", found).otherwise(now)


# Types of files that tell processed data and raw data.
PROCESSED_FILES, RAW_FILES = ("series_matrix", "supplementary", "cel"), ("fastq", "sra")


def data_format(current: Column, source: Column, file_types: Column) -> Column:
    """Processed files beat raw ones; only where nothing is known yet and the source does not say it itself."""
    has = lambda kinds: F.arrays_overlap(F.coalesce(file_types, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in kinds]))
    now = F.coalesce(current, F.lit("unknown"))
    open_ = (now == "unknown") & (F.lower(F.coalesce(source, F.lit(""))) != "pride_archive")
    return F.when(open_ & has(PROCESSED_FILES), "processed").when(open_ & has(RAW_FILES), "raw").otherwise(now)
