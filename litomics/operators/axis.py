"""The disease axis of datasets, decided from their texts: candidate terms, hits on reference names, suppression of parts, and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, normal_name
from ..session import written
from .disease import fuzzy_hits

AXES = ("monogenic", "multifactorial")
#: Least similarity of a name that is not equal, by axis.
LEAST = {"monogenic": 0.82, "multifactorial": 0.70}
MOST_WORDS, LEAST_CHARS = 4, 6
#: Characters of a summary that are read, as the contract has it: its beginning names the disease.
SUMMARY_CHARS = 200

# Words that alone, or among themselves, name no disease.
BLOCKED = (
    "stress death lifespan study analysis expression function response regulation activity pathway network mechanism outcome survival progression resistance sensitivity exposure measurement "
    "cell cells tissue organ protein gene genes genome snp locus variant mutation allele marker phenotype trait risk disease disorder syndrome condition infection inflammation deficiency "
    "type form level rate ratio score index model group case control human mouse patient cohort sample data onset age sex body blood serum plasma"
).split()


def grams(text: Column) -> Column:
    """array<struct<at, gram>>: lower-case runs of 1 to MOST_WORDS words in order of their beginning, then their length, without those that name no disease."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9][A-Za-z0-9\-]*[A-Za-z0-9]|[A-Za-z0-9])"), F.lit(1)), lambda w: F.lower(w))
    blocked = F.array(*map(F.lit, BLOCKED))

    def of(n: int, words: Column, free: Column) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        fine = lambda i: F.exists(F.slice(free, i + 1, n), lambda x: x) & ((F.lit(n) > 1) | (F.length(F.get(words, i)) >= LEAST_CHARS))
        return F.transform(F.filter(starts, fine), lambda i: F.struct((i * 10 + n).cast("long").alias("at"), F.array_join(F.slice(words, i + 1, n), " ").alias("gram")))

    every = lambda words, free: F.array_sort(F.flatten(F.array(*[of(n, words, free) for n in range(1, MOST_WORDS + 1)])))
    return bound(words, lambda words: bound(F.transform(words, lambda w: ~F.array_contains(blocked, w)), lambda free: every(words, free)))


def candidates(datasets: DataFrame, subjects: DataFrame) -> DataFrame:
    """(id, norms, kinds) of every dataset: its normalised terms, each once, in order of where it stands first. datasets: id, title, summary, disease_raw (array); subjects: id, descriptor, is_major.

    In this order: the terms its archive gives, subject headings (major ones first), runs of words of the title, the title, runs of words of the summary's beginning, that beginning. A kind is gram for runs
    of words, which are held against equal names only, and whole for all else. Headings meet their dataset as a list of different ones, so that no other term leaves its row."""
    none = F.lit("")
    title, summary = F.trim(F.coalesce("title", none)), F.substring(F.trim(F.coalesce("summary", none)), 1, SUMMARY_CHARS)
    headings = subjects.where("descriptor is not null").groupBy("id", "descriptor").agg(F.max(F.coalesce("is_major", F.lit(False))).alias("major"))
    listed = headings.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((~F.col("major")).alias("minor"), "descriptor"))).alias("headings"))
    whole = lambda terms: F.transform(terms, lambda x: F.struct(normal_name(x).alias("norm"), F.lit("whole").alias("kind")))
    # runs of words are normal as they are
    runs = lambda text: F.transform(grams(text), lambda g: F.struct(g["gram"].alias("norm"), F.lit("gram").alias("kind")))
    given = F.coalesce("disease_raw", F.array().cast("array<string>"))
    own = F.coalesce(F.transform("headings", lambda h: h["descriptor"]), F.array().cast("array<string>"))
    every = F.filter(F.concat(whole(given), whole(own), runs(title), whole(F.array(title)), runs(summary), whole(F.array(summary))), lambda c: c["norm"] != "")
    rows = datasets.repartition("id").join(listed, "id", "left").select("id", every.alias("every"))
    norms = rows.select("id", "every", F.transform("every", lambda c: c["norm"]).alias("all")).withColumn("norms", F.array_distinct("all"))
    return norms.select("id", "norms", F.transform("norms", lambda n: F.get("every", (F.array_position("all", n) - 1).cast("int"))["kind"]).alias("kinds"))


def each(found: DataFrame) -> DataFrame:
    """(id, norm, seq, kind): a row for each candidate."""
    return found.select("id", F.posexplode(F.arrays_zip("norms", "kinds")).alias("seq", "c")).select("id", F.col("c.norms").alias("norm"), "seq", F.col("c.kinds").alias("kind"))


def hits(found: DataFrame, names: DataFrame) -> DataFrame:
    """(norm, axis, name, score, method, grams): of each term the equal name of an axis, else its most similar one if that reaches the axis' least; grams: whether runs of words may use it. names: axis, name."""
    refs = names.select("axis", normal_name(F.col("name")).alias("norm"), "name").groupBy("axis", "norm").agg(F.min("name").alias("name"))
    terms = found.groupBy("norm").agg(F.max(F.col("kind") == "whole").alias("whole"))
    equal = terms.join(refs, "norm").select("norm", "axis", "name", F.lit(1.0).alias("score"), F.lit("exact").alias("method"), F.lit(True).alias("grams"))
    near = fuzzy_hits(terms.where("whole").select(F.col("norm").alias("term")), names, min(LEAST.values()))
    least = F.coalesce(*[F.when(F.col("axis") == a, v) for a, v in LEAST.items()])
    near = near.where(F.col("ratio") >= least).select(F.col("term").alias("norm"), "axis", "name", F.col("ratio").alias("score"), F.lit("fuzzy").alias("method"), F.lit(False).alias("grams"))
    return equal.unionByName(near.join(equal, ["norm", "axis"], "left_anti"))


def classify(datasets: DataFrame, subjects: DataFrame, names: DataFrame) -> DataFrame:
    """(id, axis, score, method, n_candidates, monogenic_name, multifactorial_name) of every dataset.

    Of each axis the best hit counts, the first of equally good ones. Where both are of runs of words and one name is part of the other, the shorter is no finding of its own and goes. Then: mixed, the one axis with
    a hit, or indeterminate; the score is the better one, and the method that of the better axis, the monogenic one if equal."""
    found = written(candidates(datasets, subjects), "candidates")
    # written, so that their size is known: where they are few they go to the candidates, and not those to them
    met = each(found).join(written(hits(each(found), names), "hits"), "norm").where((F.col("kind") == "whole") | F.col("grams"))
    best = met.groupBy("id", "axis").agg(F.min_by(F.struct("score", "method", "name", "kind"), F.struct(-F.col("score"), "seq")).alias("h"))
    sides = best.groupBy("id").agg(*[F.max(F.when(F.col("axis") == a, F.col("h"))).alias(a) for a in AXES])
    one, two = (normal_name(F.col(f"{a}.name")) for a in AXES)
    grams_both = F.coalesce((F.col("monogenic.kind") == "gram") & (F.col("multifactorial.kind") == "gram"), F.lit(False))
    drop_one, drop_two = grams_both & F.contains(two, one), grams_both & ~F.contains(two, one) & F.contains(one, two)
    kept = sides.select("id", F.when(~drop_one, F.col("monogenic")).alias("m"), F.when(~drop_two, F.col("multifactorial")).alias("f"))
    rows = found.select("id", F.size("norms").cast("long").alias("n_candidates")).join(kept, "id", "left")
    has_m, has_f = F.col("m").isNotNull(), F.col("f").isNotNull()
    return rows.select(
        "id", F.when(has_m & has_f, "mixed").when(has_m, "monogenic").when(has_f, "multifactorial").otherwise("indeterminate").alias("axis"), F.greatest(F.coalesce("m.score", F.lit(0.0)), F.coalesce("f.score", F.lit(0.0))).alias("score"),
        F.when(has_m & (F.col("m.score") >= F.coalesce("f.score", F.lit(0.0))), F.col("m.method")).when(has_f, F.col("f.method")).otherwise("none").alias("method"),
        "n_candidates", F.col("m.name").alias("monogenic_name"), F.col("f.name").alias("multifactorial_name"),
    )
