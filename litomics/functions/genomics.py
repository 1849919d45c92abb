"""Genomic keys, effects and directions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAMAGING = 0.5
# Magnitudes of clinical terms; the first that a text holds counts.
ONCOGENICITY = {"oncogenic": 1.0, "likely oncogenic": 0.9, "likely benign": 0.1, "benign": 0.0}
SIGNIFICANCE = {"likely pathogenic": 0.9, "likely benign": 0.1, "likely oncogenic": 0.9, "pathogenic": 1.0, "benign": 0.0, "oncogenic": 1.0}
UNDECIDED = ("uncertain", "vus", "conflicting", "not provided", "other")
CONFIDENCE = {"clinvar": 0.9, "alphamissense": 0.7, "dbnsfp": 0.6}
TRUNCATING = ("frame_shift_del", "frame_shift_ins", "nonsense_mutation", "splice_site", "translation_start_site", "nonstop_mutation")
MISSENSE = ("missense_mutation", "in_frame_del", "in_frame_ins")
NONSYNONYMOUS = (*TRUNCATING, *MISSENSE)
GENE_ROLES = {"ONCOGENE": "oncogene", "TSG": "tsg", "ONCOGENE_AND_TSG": "oncogene_and_tsg", "NEITHER": "neither"}


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """CHROM:POS:REF:ALT without chr prefix; an indel loses one shared leading base. Null for several or spanning alleles."""
    name = F.regexp_replace(chrom, r"(?i)^chr(?=.)", "")
    bad = alt.contains(",") | (alt == "*") | (alt == "") | (name == "")
    shared = (F.substring(ref, 1, 1) == F.substring(alt, 1, 1)) & (ref != "") & ((F.length(ref) > 1) | (F.length(alt) > 1))
    number = F.expr("null").cast("long") if pos is None else pos.try_cast("long")
    single = (F.length(ref) == 1) & (F.length(alt) == 1)
    cut = lambda x: F.when(shared, F.substr(x, F.lit(2))).otherwise(x)
    place = F.when(shared, number + 1).otherwise(number).cast("string")
    return F.when(bad, None).when(single, F.concat_ws(":", name, pos.cast("string"), ref, alt)).when(number.isNotNull(), F.concat_ws(":", name, place, cut(ref), cut(alt)))


def info_value(info: Column, key: str) -> Column:
    """The value of a key in `k=v;flag;k=v` text; null where it is absent or empty."""
    return F.nullif(F.regexp_extract(F.coalesce(info, F.lit("")), rf"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def first_gene(geneinfo: Column) -> Column:
    """The first symbol of `SYM:id|SYM:id`, in upper case."""
    return F.upper(F.nullif(F.trim(F.split_part(F.split_part(geneinfo, F.lit("|"), F.lit(1)), F.lit(":"), F.lit(1))), F.lit("")))


def clinvar_magnitude(oncogenicity: Column, significance: Column, underscores: bool = False) -> Column:
    """Magnitude of a clinical classification; null where it is undecided. Oncogenicity, exact, comes before significance.

    With `underscores` they are read as blanks; without, `likely_pathogenic` holds only `pathogenic`."""
    clean = lambda c: F.lower(F.trim(F.coalesce(F.regexp_replace(c, "_", " ") if underscores else c, F.lit(""))))
    onco, sig = clean(oncogenicity), clean(significance)
    exact = F.lit(None).cast("double")
    for k, v in ONCOGENICITY.items():
        exact = F.when(onco == k, v).otherwise(exact)
    undecided = F.lit(False)
    for p in UNDECIDED:
        undecided = undecided | sig.contains(p)
    partial = F.coalesce(*[F.when(sig.contains(k), F.lit(v)) for k, v in SIGNIFICANCE.items()])
    return F.when(onco != "", exact).when((sig == "") | undecided, None).otherwise(partial)


def effect_class(magnitude: Column) -> Column:
    return F.when(magnitude >= 0.8, "damaging").when(magnitude <= 0.3, "benign").otherwise("uncertain")


def effect_direction(magnitude: Column, role: Column) -> Column:
    """Inactivator for a damaged suppressor, activator for a damaged oncogene, else neutral."""
    return F.when(magnitude < DAMAGING, "neutral").when(role == "tsg", "inactivator").when(role == "oncogene", "activator").otherwise("neutral")


def copy_direction(role: Column, value: Column, gain: float = 0.3, loss: float = -0.3) -> Column:
    """Activator for a gained oncogene, inactivator for a lost suppressor, else null."""
    return F.when((role == "oncogene") & (value >= gain), "activator").when((role == "tsg") & (value <= loss), "inactivator")


def gene_role(gene_type: Column) -> Column:
    kind = F.upper(F.trim(F.coalesce(gene_type, F.lit(""))))
    out = F.lit("unknown")
    for k, v in GENE_ROLES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def edge_sign(subtypes: Column) -> Column:
    """1, -1 or 0 for a list of relation subtypes; activation and inhibition together cancel."""
    plus = F.exists(subtypes, lambda s: s.isin("activation", "expression"))
    minus = F.exists(subtypes, lambda s: s.isin("inhibition", "repression"))
    return F.when(plus & minus, 0).when(plus, 1).when(minus, -1).otherwise(0)


def regulon_sign(stimulation: Column, inhibition: Column) -> Column:
    """1, -1 or 0 from two flags written as 1 or true."""
    yes = lambda c: F.lower(F.trim(c.cast("string"))).isin("1", "true")
    return F.when(yes(stimulation) & ~yes(inhibition), 1).when(yes(inhibition) & ~yes(stimulation), -1).otherwise(0)


def case_id(characteristics: Column, accession: Column) -> Column:
    """The case of a sample: its characteristics, else the accession without a role's suffix, else the accession."""
    named = F.nullif(F.trim(F.coalesce(characteristics["case_id"], F.lit(""))), F.lit(""))
    cut = F.nullif(F.regexp_extract(accession, r"(?i)^(.+?)[-_.](?:T|N|TUMOR|NORMAL)[0-9]*$", 1), F.lit(""))
    return F.coalesce(named, cut, accession)
