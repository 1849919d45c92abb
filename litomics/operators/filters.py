"""Filters of lists, built from the parameters that a caller gives; each unknown or malformed value is ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_number(x: object) -> int | None:
    try:
        return int(str(x))
    except (TypeError, ValueError):
        return None


def json_score(confidence: Column, axis: str) -> Column:
    """The score of an axis in a JSON text: the value itself, or its `score` if it is an object; null where it is absent."""
    v = F.try_parse_json(confidence)
    return F.coalesce(F.try_variant_get(v, f"$.{axis}.score", "double"), F.try_variant_get(v, f"$.{axis}", "double"))


def apply(rows: DataFrame, params: dict[str, object], *, equal: tuple[str, ...] = (), contains: tuple[str, ...] = (), at_least: dict[str, str] | None = None, at_most: dict[str, str] | None = None, present: dict[str, str] | None = None, one_of: dict[str, str] | None = None, has: dict[str, str] | None = None, scores: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """All given conditions together.

    equal: columns compared as they are. contains: literal parts of text, letter case ignored. at_least, at_most: parameter to numeric
    column. present: parameter to text column that must not be blank when the value is true. one_of: parameter (a list) to column. has:
    parameter to array column. scores: parameter to (JSON column, axis)."""
    conditions = [F.col(c) == params[c] for c in equal if params.get(c) not in (None, "")]
    conditions += [F.contains(F.lower(F.col(c)), F.lower(F.lit(str(params[c])))) for c in contains if params.get(c)]
    for name, column in (at_least or {}).items():
        if (n := whole_number(params.get(name))) is not None:
            conditions.append(F.col(column) >= n)
    for name, column in (at_most or {}).items():
        if (n := whole_number(params.get(name))) is not None:
            conditions.append(F.col(column) <= n)
    conditions += [F.coalesce(F.col(column), F.lit("")) != "" for name, column in (present or {}).items() if str(params.get(name)).lower() == "true"]
    conditions += [F.col(column).isin(list(params[name])) for name, column in (one_of or {}).items() if params.get(name)]
    conditions += [F.array_contains(column, params[name]) for name, column in (has or {}).items() if params.get(name)]
    for name, (column, axis) in (scores or {}).items():
        if params.get(name) is not None:
            conditions.append(json_score(F.col(column), axis) >= float(params[name]))
    for c in conditions:
        rows = rows.where(c)
    return rows


def json_has(document: Column, parent: str, key: str) -> Column:
    """Whether an object inside a JSON text has a key, be its value null."""
    keys = F.json_object_keys(F.get_json_object(document, parent))
    return F.coalesce(F.array_contains(keys, key), F.lit(False))


def paper_filters(rows: DataFrame, params: dict[str, object], categories: DataFrame | None = None) -> DataFrame:
    """Papers by status, years, journal, type, abstract, free full text, relevance, job and clinical category.

    rows: paper_id, curation_status, pub_year, journal, pub_type, abstract, pmc_id, relevance_score, ingestion_job. categories: paper_id, slug, many for a paper."""
    out = apply(
        rows, params, equal=("curation_status", "pub_type", "ingestion_job"), contains=("journal",), at_least={"pub_year_min": "pub_year"}, at_most={"pub_year_max": "pub_year"},
        present={"has_abstract": "abstract", "free_full_text": "pmc_id"},
    )
    for name, sign in (("relevance_min", 1), ("relevance_max", -1)):
        if params.get(name) is not None:
            out = out.where(sign * F.col("relevance_score") >= sign * float(str(params[name])))
    if params.get("clinical_category") and categories is not None:
        out = with_match(out, categories.where(F.col("slug") == params["clinical_category"]), "paper_id")
    return out


def sample_filters(rows: DataFrame, params: dict[str, object]) -> DataFrame:
    """Samples whose status is one of a list, and by parts of organism and platform."""
    return apply(rows, params, one_of={"curation_status": "curation_status"}, contains=("organism", "platform"))


def with_match(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key another table has; never more than once each."""
    return rows.join(others.select(key), key, "left_semi")


def flagged(rows: DataFrame, others: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows with a boolean: whether another table has their key."""
    return rows.join(others.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def curation_queue(rows: DataFrame, axis_column: str, confidence: str, axis: str, limit: float = 0.5) -> DataFrame:
    """Rows whose axis is unknown although it was scored, below the limit; oldest first."""
    score = json_score(F.col(confidence), axis)
    return rows.where((F.col(axis_column) == "unknown") & score.isNotNull() & (score < limit)).orderBy("added_at", "id")


def has_gene_hit(metadata: Column) -> Column:
    """Whether the metadata's contract tells of a monogenic hit with one gene or more; false for what is absent, null, empty or no JSON."""
    genes = F.get_json_object(metadata, "$.contract.monogenic_gene_hit.genes")
    return F.coalesce(~F.regexp_replace(genes, r"\s", "").isin("", "[]", "{}", "null", "false", "0"), F.lit(False))


def high_value_queue(rows: DataFrame) -> DataFrame:
    """Mixed rows first, then discordant ones (a monogenic hit on another axis), each oldest first, with the reason. The hit is that of the JSON in `metadata`, or n_hits where there is no such column."""
    hit = has_gene_hit(F.col("metadata")) if "metadata" in rows.columns else F.col("n_hits") > 0
    reason = F.when(F.col("axis") == "mixed", "mixed").when(F.coalesce(F.col("axis"), F.lit("")) != "monogenic", F.when(hit, "discordance"))
    return rows.withColumn("reason", reason).where("reason is not null").orderBy(F.when(F.col("reason") == "mixed", 0).otherwise(1), "added_at", "id")


def bulk_update(rows: DataFrame, key: str, status: str, reason: str | None, ids: list | DataFrame | None = None, condition: Column | None = None) -> DataFrame:
    """Rows with a new status, and a new reason if one is given, for the ids (a list, or a table with the key) or the condition; exactly one of the two."""
    if (ids is None) == (condition is None):
        raise ValueError("either ids or a condition")
    columns = rows.columns
    if ids is not None:
        listed = ids if isinstance(ids, DataFrame) else rows.sparkSession.createDataFrame([(i,) for i in ids], rows.select(key).schema)
        rows = rows.join(listed.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) if ids is not None else condition
    out = rows.withColumn("curation_status", F.when(hit, F.lit(status)).otherwise(F.col("curation_status")))
    if reason is not None:
        out = out.withColumn("curation_reason", F.when(hit, F.lit(reason)).otherwise(F.col("curation_reason")))
    return out.select(columns)
