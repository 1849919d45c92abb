"""Citations of entities in a project's papers: lists, details, contexts, recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written


def entity_list(mentions: DataFrame, papers: DataFrame, key: str, extra: dict[str, Column] | None = None, q: str | None = None, included_only: bool = False, major: str | None = None) -> DataFrame:
    """Per entity: papers that cite it, included ones, summed mentions, and the maxima in `extra`.

    mentions: paper_id, key, mention_count and more. papers: paper_id, included, unique per paper. `q` restricts keys before they
    are counted; `included_only` drops entities without an included paper afterwards. Mentions are first
    summed per entity and paper, so counts are of papers and need no distinct count."""
    rows = mentions if q is None else mentions.where(F.contains(F.lower(F.col(key)), F.lit(q.lower())))
    extra = extra or {}
    per_paper = rows.groupBy(key, "paper_id").agg(F.sum("mention_count").alias("m"), *([F.bool_or(F.col(major)).alias("major")] if major else []), *[F.max(c).alias(k) for k, c in extra.items()])
    joined = per_paper.join(papers.select("paper_id", "included"), "paper_id")
    aggs = [
        F.count("*").alias("total_papers"), F.count_if("included").alias("included_papers"), F.sum("m").cast("long").alias("mentions"),
        *([F.count_if(F.col("major") & F.col("included")).alias("major_topic_count")] if major else []), *[F.max(k).alias(k) for k in extra],
    ]
    out = joined.groupBy(key).agg(*aggs)
    return out.where("included_papers > 0") if included_only else out


def entity_detail(mentions: DataFrame, papers: DataFrame, key: str, value: str, qualifier: str) -> DataFrame:
    """One entity's counts with its distinct qualifiers, sorted, joined by commas."""
    one = mentions.where(F.col(key) == value).join(papers.select("paper_id", "included"), "paper_id")
    per_paper = one.groupBy(key, "paper_id").agg(F.bool_or("included").alias("included"), F.sum("mention_count").alias("m"), F.collect_set(qualifier).alias("q"))
    return per_paper.groupBy(key).agg(
        F.count("*").alias("total_papers"), F.count_if("included").alias("included_papers"), F.sum("m").cast("long").alias("mentions"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("q")))), ",").alias("qualifiers"),
    )


def contexts(papers: DataFrame, mentions: DataFrame, key: str, splitter=T.sentences) -> DataFrame:
    """(paper_id, key, position, sentence) of sentences that mention the entity; position -1 marks pairs without any.

    papers: paper_id, text. Each paper is split once; its entities are looked for in each of its sentences."""
    split = papers.select("paper_id", F.posexplode_outer(splitter(F.col("text"))).alias("position", "sentence"))
    pairs = mentions.select("paper_id", key).distinct()
    # a part of the sentence is looked for first: a pattern built by row is compiled by row
    part = F.contains(F.lower("sentence"), F.lower(F.col(key)))
    met = pairs.join(split, "paper_id").where(part).where(T.mentions(F.col("sentence"), F.col(key)))
    return pairs.join(met, ["paper_id", key], "left").select("paper_id", key, F.coalesce("position", F.lit(-1)).alias("position"), "sentence")


def stale(papers: DataFrame, contexts_: DataFrame) -> DataFrame:
    """(paper_id, computing): whether a paper has no context or one older than itself."""
    last = contexts_.groupBy("paper_id").agg(F.min("computed_at").alias("computed_at"))
    return papers.join(last, "paper_id", "left").select("paper_id", (F.col("computed_at").isNull() | (F.col("computed_at") < F.col("updated_at"))).alias("computing"))


# The words of a sentence that make a short symbol a gene's.
BIO_CONTEXT = (
    r"(?i)\b(gene|protein|express|mutat|variant|allele|locus|transcript|mRNA|encod|regulat|pathway|receptor|kinase|inhibit|activat|phosphoryl"
    r"|knockout|knockdown|overexpress|silenc|polymorphism|SNP|amplif|delet|fusion|transloc|promoter|enhancer|exon|intron|domain|isoform|signaling"
    r"|oncogene|tumor.?suppress|methylat|acetylat|ubiquitin|apoptos|proliferat)\b"
)


def recognise_genes(papers: DataFrame, symbols: DataFrame, stop_words: list[str] = []) -> DataFrame:  # noqa: B006
    """(paper_id, symbol, mention_count) by a dictionary (symbol, upper case) given as a table.

    A token counts as it stands; if it is no symbol and has a hyphen, its two parts joined count when the second is short, and its first
    part counts when the second is no symbol. Symbols of up to 3 characters need biomedical context in the text, 2-character ones upper case."""
    # the context is looked for once in a text, before its words are exploded
    known = symbols.select(F.upper("symbol").alias("symbol")).where(~F.col("symbol").isin(stop_words) if stop_words else F.lit(True)).distinct()
    split = papers.select("paper_id", F.coalesce("text", F.lit("")).rlike(BIO_CONTEXT).alias("bio"), F.filter(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}\-]+"), lambda w: F.length(w).between(2, 15)).alias("words"))
    words = split.select("paper_id", "bio", F.explode("words").alias("word"))
    fits = lambda c, word: F.length(c).between(2, 15) & ((F.length(c) > 3) | F.col("bio")) & ((F.length(c) != 2) | (word == c))
    # only words that are a symbol or have a hyphen can count, so the others leave before anything is grouped
    known = written(known, "symbols")
    upper = words.withColumn("u", F.upper("word"))
    met = upper.join(known.select(F.col("symbol").alias("u"), F.lit(True).alias("is_known")), "u", "left").where(F.col("is_known") | F.col("u").contains("-"))
    counted = met.groupBy("paper_id", "bio", "word", "u", F.coalesce("is_known", F.lit(False)).alias("is_known")).count()
    counted = written(counted, "words")  # what follows reads it more than once, and not the texts
    direct = counted.where(F.col("is_known") & fits(F.col("u"), F.col("word"))).select("paper_id", F.col("u").alias("symbol"), "count")
    # what was no mention as it stands, with a hyphen
    rest = counted.where(F.col("u").contains("-")).join(direct.select("paper_id", F.col("symbol").alias("u")), ["paper_id", "u"], "left_anti")
    head, tail = F.split_part("u", F.lit("-"), F.lit(1)), F.expr("substr(u, instr(u, '-') + 1)")
    parts = rest.select("paper_id", "bio", "count", head.alias("head"), tail.alias("tail")).where(F.length("head") >= 2)
    joined = parts.where(F.length("tail").between(1, 3) & F.col("tail").rlike("^[A-Z0-9]+$")).select("paper_id", "bio", "count", F.concat("head", "tail").alias("symbol"))
    alone = parts.join(known.withColumnRenamed("symbol", "tail"), "tail", "left_anti").select("paper_id", "bio", "count", F.col("head").alias("symbol"))
    more = joined.unionByName(alone).join(known, "symbol").where(fits(F.col("symbol"), F.col("symbol"))).select("paper_id", "symbol", "count")
    return direct.unionByName(more).groupBy("paper_id", "symbol").agg(F.sum("count").alias("mention_count"))


def recognise_phrases(papers: DataFrame, names: DataFrame) -> DataFrame:
    """(paper_id, name, mention_count) of dictionary phrases by whole words; where phrases overlap at a word, the longest counts.

    Word n-grams of the lengths that the dictionary has are hash-joined with it, so texts are not scanned once per name."""
    known = written(names.select(F.lower("name").alias("name")).where("name is not null").distinct(), "names")
    # a name's first word and its number of words: of all runs of words only those are made that begin as a name does
    heads = known.groupBy(F.split_part("name", F.lit(" "), F.lit(1)).alias("head")).agg(F.array_sort(F.collect_set(F.size(F.split("name", " ")))).alias("lengths"))
    words = papers.select("paper_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)([\w\-]+)"), F.lit(1)).alias("w"))
    longest = known.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    begun = words.select("paper_id", F.explode(F.transform("w", lambda x, i: F.struct(x.alias("head"), i.alias("at"), F.slice("w", i + 1, longest).alias("w")))).alias("g")).select("paper_id", "g.*").join(heads, "head")
    grams = begun.select("paper_id", "at", "w", F.explode("lengths").alias("n")).where("n <= size(w)").select("paper_id", "at", "n", F.array_join(F.slice("w", 1, F.col("n")), " ").alias("name"))
    met = grams.join(known, "name")
    per_paper = met.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(F.col("at"), (-F.col("n")).alias("minus"), F.col("name")))).alias("m"))
    start = F.expr("named_struct('until', 0, 'names', cast(array() as array<string>))")
    kept = F.aggregate("m", start, lambda a, x: F.when(x["at"] >= a["until"], F.struct((x["at"] - x["minus"]).alias("until"), F.array_append(a["names"], x["name"]).alias("names"))).otherwise(a), lambda a: a["names"])
    return per_paper.select("paper_id", F.explode(kept).alias("name")).groupBy("paper_id", "name").agg(F.count("*").alias("mention_count"))
