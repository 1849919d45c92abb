"""Identifiers and links of archives as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_ROOT = "https://ftp.ncbi.nlm.nih.gov/geo/series"
REPORT = "https://www.ebi.ac.uk/ena/portal/api/filereport"


def series(raw: Column) -> Column:
    """A series accession in upper case, with its prefix; null if there is no number."""
    number = F.regexp_extract(F.coalesce(raw.cast("string"), F.lit("")), r"([0-9]+)\s*$", 1)
    return F.when(number != "", F.concat(F.lit("GSE"), number))


def supplementary_url(accession: Column) -> Column:
    """The folder of a series' supplementary files; series stand in folders of a thousand."""
    short = F.when(F.length(accession) > 6, F.concat(F.substr(accession, F.lit(1), F.length(accession) - 3), F.lit("nnn"))).otherwise("GSEnnn")
    return F.when(accession.rlike("^GSE[0-9]+$"), F.concat(F.lit(f"{SERIES_ROOT}/"), short, F.lit("/"), accession, F.lit("/suppl/")))


def report_url(run: Column) -> Column:
    return F.concat(F.lit(f"{REPORT}?accession="), run, F.lit("&result=read_run&fields=run_accession,fastq_ftp,fastq_md5,fastq_bytes&format=tsv"))


def secure(url: Column) -> Column:
    """An https link of an ftp, http or bare one."""
    return F.concat(F.lit("https://"), F.regexp_replace(url, "^(?i:ftp|https?)://", ""))


def file_name(url: Column) -> Column:
    """The last part of a link's path, without query or fragment."""
    return F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "([^/]*)$", 1)


def is_run(accession: Column) -> Column:
    return accession.rlike("^[SED]RR[0-9]+$")


def relation_experiments(relation: Column) -> Column:
    """Experiment accessions in a free-text relation, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(relation, F.lit("")), F.lit("([SED]RX[0-9]+)"), F.lit(1)))
