"""Merges of new rows into stored ones, as joins; a caller writes the result to a new path or partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def longest_wins(rows: DataFrame, keys: list[str], text: str, seq: str) -> DataFrame:
    """One row for each key: the longest text, the first of equally long ones."""
    return first_per_key(rows, keys, F.desc(F.length(F.coalesce(text, F.lit("")))), F.asc(seq))


def batch_merge(rows: DataFrame) -> DataFrame:
    """One dataset for each accession in a batch: types and layers united and sorted, longest title and summary, JSON keys of
    later rows over earlier ones, the largest count, the first platform that is known. rows: accession, seq, title, summary, omic_type (comma list), omics_layers
    (array), metadata (map), omics_count, organism.

    Types, layers and keys are facts of an accession: each is one row with its latest value before an accession's facts meet, so what meets is bounded by the result and not by the batch."""
    longest = lambda c: F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col("seq")))
    fact = lambda kind, key, value, *made: rows.select("accession", "seq", *made).select("accession", "seq", F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    none = F.lit(None).cast("string")
    facts = (
        fact("type", F.trim("x"), none, F.explode(F.split(F.coalesce("omic_type", F.lit("")), ",")).alias("x")).where("key <> ''")
        .union(fact("layer", F.col("x"), none, F.explode("omics_layers").alias("x"))).union(fact("key", F.col("k"), F.col("v"), F.explode("metadata").alias("k", "v")))
    )
    latest = facts.groupBy("accession", "kind", "key").agg(F.max_by("value", "seq").alias("value"))
    named = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("key"))))
    united = latest.groupBy(F.col("accession").alias("_a")).agg(
        F.array_join(named("type"), ",").alias("omic_type"), named("layer").alias("omics_layers"), F.map_from_entries(F.collect_list(F.when(F.col("kind") == "key", F.struct("key", "value")))).alias("metadata")
    )
    plain = rows.groupBy("accession").agg(
        longest("title").alias("title"), longest("summary").alias("summary"), F.max("omics_count").alias("omics_count"),
        F.coalesce(F.min_by(F.when(F.col("organism") != "unknown", F.col("organism")), F.when(F.col("organism") != "unknown", F.col("seq"))), F.lit("unknown")).alias("organism"),
    )
    both = plain.join(united, F.col("accession").eqNullSafe(F.col("_a")), "left")
    empty = {"omic_type": F.lit(""), "omics_layers": F.array().cast("array<string>"), "metadata": F.expr("cast(map() as map<string,string>)")}
    return both.select("accession", "title", "summary", *[F.coalesce(c, e).alias(c) for c, e in empty.items()], "omics_count", "organism")


def longer(new: Column, old: Column) -> Column:
    """The strictly longer text, the old one otherwise."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return F.when(size(new) > size(old), new).otherwise(F.coalesce(old, new))


def given(new: Column, old: Column) -> Column:
    """The new value unless it is null or empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def known(new: Column, old: Column) -> Column:
    """The new value unless it is null, empty or unknown."""
    return F.coalesce(F.when(~F.coalesce(new, F.lit("")).isin("", "unknown"), new), old, new)


def united(new: Column, old: Column) -> Column:
    """Comma lists as one, sorted and without repeats."""
    parts = F.split(F.concat_ws(",", F.nullif(old, F.lit("")), F.nullif(new, F.lit(""))), ",")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))), ",")


def replaced(new: Column, old: Column) -> Column:
    """A new array unless it is null or empty."""
    return F.when(F.size(F.coalesce(new, F.array())) > 0, new).otherwise(old)


def over(new: Column, old: Column) -> Column:
    """Maps as one, the new one's keys over the old one's."""
    none = F.expr("cast(map() as map<string,string>)")
    n, o = F.coalesce(new, none), F.coalesce(old, none)
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k)), n)


RULES = {"over": over, "longer": longer, "given": given, "known": known, "united": united, "replaced": replaced, "new": lambda n, o: n, "coalesce": F.coalesce, "old": lambda n, o: F.coalesce(o, n)}


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Stored rows merged with new ones, unique by key each; `rules` says for each other column how (see RULES)."""
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rules], F.lit(True).alias("_n"))
    o = stored.select(*keys, *rules, F.lit(True).alias("_o"))
    both = o.join(n, keys, "full_outer")
    merge = lambda c, rule: F.when(F.col("_n").isNull(), F.col(c)).when(F.col("_o").isNull(), F.col(f"_n_{c}")).otherwise(RULES[rule](F.col(f"_n_{c}"), F.col(c)))
    return both.select(*keys, *[merge(c, r).alias(c) for c, r in rules.items()])


#: How stored files of datasets, samples, raw variant effects and runs of samples take new ones.
FILE_RULES = {"storage_key": "new", "size_bytes": "coalesce", "checksum_md5": "coalesce", "download_status": "new", "bytes_downloaded": "new", "error_message": "new"}
SAMPLE_RULES = {"title": "longer", "source_name": "given", "organism": "given", "tax_id": "coalesce", "platform": "given", "characteristics": "over", "extra_metadata": "over"}
VARIANT_RULES = {
    "raw_magnitude": "coalesce", "raw_class": "new", "clinvar_significance": "new", "oncogenicity": "given", "am_pathogenicity": "coalesce", "confidence": "coalesce", "source_version": "new",
}
RUN_RULES = {"url": "new", "size_bytes": "new", "md5": "new"}


def sample_upsert(stored: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Samples by accession: of a batch the first with an accession counts, then it is merged by SAMPLE_RULES."""
    return upsert(stored, first_per_key(batch, ["accession"], F.asc(seq)), ["accession"], SAMPLE_RULES)


def run_upsert(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Runs by sample and run; stored ones that a batch lacks stay."""
    return upsert(stored, batch, ["sample_id", "run"], RUN_RULES)


def insert_missing(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, and new ones whose key is not stored; existing rows stay as they are."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(keys), keys, "left_anti").select(stored.columns))


def mention_counts(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Counts summed within the batch, then put over stored ones, not added to them."""
    summed = batch.groupBy(*keys).agg(F.sum("mention_count").cast("long").alias("mention_count"))
    return upsert(stored, summed, keys, {"mention_count": "new"})


def order_free_checksum(rows: DataFrame) -> DataFrame:
    """Rows and a sum of row hashes: equal tables have equal checksums, whatever the order of rows or files."""
    return rows.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string").alias("checksum"))
