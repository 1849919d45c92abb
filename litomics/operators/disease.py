"""Disease names: exact and fuzzy hits against reference names, and the axis they speak for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normal_name
from .similarity import with_best

LEAST_TOKEN, MOST_TOKENS = 5, 3
#: Names of a tile, terms of a part, and pairs of a part and a tile, of one token: all about so many at most. Between its least and most, a part has as many terms as a tile has names.
TILE, LEAST_PART, PART, PAIRS = 1 << 16, 1 << 9, 1 << 14, 1 << 28


def exact_hits(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, axis, name) of equal normalised names. terms: term; names: axis, name."""
    t = terms.select("term", normal_name(F.col("term")).alias("n")).distinct()
    return t.join(names.select("axis", "name", normal_name(F.col("name")).alias("n")), "n").select("term", "axis", "name")


def fuzzy_hits(terms: DataFrame, names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(term, axis, name, ratio): the most similar name of each axis, if it reaches the threshold.

    A term meets the names that hold its rarest token (of its first MOST_TOKENS with LEAST_TOKEN characters), all of them however common that is. The ratio is that of longest matching blocks; pairs whose
    common letters cannot reach the threshold, or a term's best name so far, never get that far (see similarity). Of equally similar names the first counts."""
    n = names.select("axis", "name", normal_name(F.col("name")).alias("n")).distinct()
    tokens = n.select("axis", "n", "name", F.explode(F.array_distinct(F.split("n", " "))).alias("token")).where(F.length("token") >= LEAST_TOKEN)
    counts = tokens.groupBy("axis", "token").agg(F.count("*").alias("names"))
    t = terms.select("term", normal_name(F.col("term")).alias("q")).distinct()
    first = F.slice(F.filter(F.split("q", " "), lambda w: F.length(w) >= LEAST_TOKEN), 1, MOST_TOKENS)
    asked = t.select("term", "q", F.posexplode(first).alias("at", "token")).join(counts, "token")
    rarest = asked.groupBy("term", "q", "axis").agg(F.min_by("token", F.struct("names", "at")).alias("token"))
    # a token's names are cut into tiles and its terms into parts; each part meets each tile, so that neither a row for each pair is made nor a common token is one task
    loads = counts.join(rarest.groupBy("axis", "token").agg(F.count("*").alias("terms")), ["axis", "token"], "left")
    pairs, size = F.col("terms") * F.least(F.col("names"), F.lit(TILE)), F.least(F.greatest(F.col("names"), F.lit(LEAST_PART)), F.lit(PART))
    cuts = loads.select("axis", "token", F.ceil(F.col("names") / TILE).alias("tiles"), F.greatest(F.ceil(F.col("terms") / size), F.ceil(pairs / PAIRS)).alias("parts"))
    # few, for each is of many names or terms; one that no term asks for has no parts
    cut = F.broadcast(cuts.select("axis", "token", "tiles", F.coalesce("parts", F.lit(0)).alias("parts")).where("tiles > 1 or parts > 1"))
    tasks, place = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), ("axis", "token", "part")
    of = lambda text, count: F.pmod(F.xxhash64(text), F.coalesce(count, F.lit(1)))
    dealt = rarest.join(cut, ["axis", "token"], "left").select("axis", "token", of("q", "parts").alias("part"), "term", "q").repartition(tasks, *place)
    groups = dealt.groupBy(*place).agg(F.collect_list(F.struct("term", "q")).alias("terms"))
    held = tokens.join(cut, ["axis", "token"], "left").select("axis", "token", of("n", "tiles").alias("tile"), F.coalesce("parts", F.lit(1)).alias("parts"), "n", "name").where("parts > 0")
    each = held.groupBy("axis", "token", "tile", "parts", "n").agg(F.min("name").alias("name"))
    tiles = each.groupBy("axis", "token", "tile", "parts").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("names"))
    spread = tiles.select("axis", "token", "names", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")).repartition(tasks, *place)
    hits = with_best(groups.join(spread, list(place)), threshold)
    best = hits.groupBy("term", "axis").agg(F.min_by(F.struct("name", "ratio"), F.struct(-F.col("ratio"), "n", "name")).alias("b"))
    return best.select("term", "axis", "b.name", "b.ratio")


def longest_only(hits: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """Hits whose name is no part of a longer hit of the same row."""
    longer = hits.select(key, F.col(name).alias("longer"))
    covered = hits.join(longer, key).where((F.length("longer") > F.length(name)) & F.contains("longer", F.col(name))).select(hits[key], hits[name]).distinct()
    return hits.join(covered, [key, name], "left_anti")


def axis(hits: DataFrame, key: str = "id", least: float = 0.85) -> DataFrame:
    """(key, axis, score): the one axis with hits; `mixed` if both have some; only scores from `least` on count."""
    per = hits.where(F.col("ratio") >= least).groupBy(key, "axis").agg(F.max("ratio").alias("score"))
    return per.groupBy(key).agg(F.when(F.count("*") > 1, "mixed").otherwise(F.first("axis")).alias("axis"), F.max("score").alias("score"))


def monogenic_hits(dataset_genes: DataFrame, mendelian: DataFrame) -> DataFrame:
    """Per dataset the Mendelian genes it has, and the best confidence among them (assessed before not assessed)."""
    best = mendelian.groupBy(F.upper("symbol").alias("symbol")).agg(F.max(F.when(F.col("confidence") == "assessed", 2).otherwise(1)).alias("level"), F.max("score").alias("score"))
    met = dataset_genes.select("dataset_id", F.upper("gene_symbol").alias("symbol")).distinct().join(best, "symbol")
    return met.groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("genes"), F.count("*").alias("n_hits"), F.when(F.max("level") == 2, "assessed").otherwise("not_assessed").alias("confidence"), F.max("score").alias("score"))
