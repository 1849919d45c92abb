"""Secret scan: patterns, then sliding-window Shannon entropy per character class over candidate strings.

All of it is DataFrame expressions. Places of matches come from the pieces between them: split() and
regexp_extract_all() run the same expression, so a match begins after all earlier pieces and matches.

A candidate is a whole run of the class's characters, 20 or more of them. A window of WINDOW characters slides over it; counts per
character are kept incrementally (one goes up, one down at each step) and with them the sum of c*log2(c), from which the
window's entropy follows. A candidate whose best window reaches its class's threshold is a span of kind `entropy`,
unless the allow list suppresses it or it overlaps a span of the patterns.

Nulls: a null text is empty. Empty texts and texts without a match give zero counts and an empty list. Repeated rows
stay. An empty table gives an empty result. Work grows with the text's length; no text is cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed values of the base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_START = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: The same runs as AKIA[A-Z0-9]+ of 18 or more, and [0-9a-f]+ of 16 or more: a shorter run has no part that is longer.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGN = 12

WINDOW = 20
#: name, characters of the class, least bits of a window. Candidates of a class are runs of it that also hold a digit and a letter.
CLASSES = (
    ("hex", "0123456789abcdefABCDEF", 3.0),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.75),
)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
#: What is random but no secret: UUIDs, digests named as such, paths of words, placeholders. Repeats of groups are possessive: the matcher walks them
#: in a loop, while it would go one call deeper for each round of an ordinary one.
ALLOWED = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|^(sha(1|256|384|512)|md5)[-=_]|^(?:/?[a-z]++[/_-])++[a-z0-9]{0,12}$|EXAMPLE|example|xxxx|XXXX"

KINDS = ("assign", "access", "hex", "entropy")


#: Matches whose places are summed up together.
BLOCK = 128


def matches_at(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of a pattern's matches, leftmost and non-overlapping, in code points.

    Places are running sums over gaps and matches, in blocks: a sum over all matches by appending would copy the list at each of them."""
    gaps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found")))
    span = "struct<start:int,end:int,found:string>"

    def in_block(part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["found"])
            return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))).alias("spans"))

        return F.aggregate(part, F.expr("struct(0 as at, array() as spans)").cast(f"struct<at:int,spans:array<{span}>>"), step)

    def moved(acc: Column, block: Column) -> Column:
        return F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))

    def joined(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.expr("struct(0 as at, array() as starts)").cast("struct<at:int,starts:array<int>>"), moved, lambda acc: acc["starts"])
        shift = lambda block, by: F.transform(block["spans"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["found"].alias("found")))
        return F.flatten(F.zip_with(blocks, starts, shift))

    def of(some: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(some), F.lit(BLOCK)), lambda k: k < F.size(some))
        # transform over an array of one binds what is used twice
        return F.get(F.transform(F.array(F.transform(firsts, lambda k: in_block(F.slice(some, k + 1, BLOCK)))), joined), F.lit(0))

    # the last piece has no match after it
    return F.get(F.transform(F.array(F.filter(gaps, lambda x: x["found"].isNotNull())), of), F.lit(0))


NONE = "array<struct<start:int,end:int,found:string>>"


def guarded(text: Column, test: str, pattern: str) -> Column:
    """matches_at, worked out only where a cheaper test finds something."""
    return F.when(text.rlike(test), matches_at(text, pattern)).otherwise(F.array().cast(NONE))


def best_entropy(found: Column, alphabet: str) -> Column:
    """Most bits of any window of WINDOW characters; null if the string is shorter or holds other characters.

    The counts are a string with one letter for each character of the class, A for none; a step overlays two of its letters."""
    w = WINDOW
    table_ = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 2)])
    code = F.transform(F.split(found, ""), lambda c: F.instr(F.lit(alphabet), c))
    f = lambda count: F.get(table_, count)
    count_of = lambda counts, k: F.ascii(F.substring(counts, k, F.lit(1))) - 65
    with_count = lambda counts, k, n: F.overlay(counts, F.char(n + 65), k, F.lit(1))

    start = F.struct(F.lit("A" * len(alphabet)).alias("counts"), F.lit(0.0).alias("weight"), F.lit(-1.0).alias("best"))

    def over(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.get(codes, i - w)
            up = count_of(acc["counts"], new)
            counts = with_count(acc["counts"], new, up + 1)
            added = acc["weight"] + f(up + 1) - f(up)
            down = count_of(acc["counts"], old) + F.when(old == new, 1).otherwise(0)
            weight = F.when(i >= w, added + f(down - 1) - f(down)).otherwise(added)
            best = F.when(i >= w - 1, F.greatest(acc["best"], F.lit(math.log2(w)) - weight / w)).otherwise(acc["best"])
            return F.struct(F.when(i >= w, with_count(counts, old, down - 1)).otherwise(counts).alias("counts"), weight.alias("weight"), best.alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["best"])

    # transform over a single codes array binds it once
    bound = F.get(F.transform(F.array(code), over), F.lit(0))
    return F.when(F.length(found) >= w, bound)


def entropy_spans(text: Column) -> Column:
    """Spans of candidate strings with a window of high entropy that the allow list does not name."""

    def random(x: Column) -> Column:
        found = x["found"]
        tests = [F.coalesce(found.rlike(f"^[{a.replace('-', '')}{'-' if '-' in a else ''}]+$") & (best_entropy(found, a) >= least), F.lit(False)) for _, a, least in CLASSES]
        hex_, base64 = tests
        is_hex = found.rlike("^[0-9a-fA-F]+$")
        return ~found.rlike(ALLOWED) & F.when(is_hex, hex_).otherwise(base64)

    return F.filter(guarded(text, "[0-9]", CANDIDATE), random)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every row of `docs`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select("doc_id", text.alias("t"))
    t = F.col("t")
    group_2 = lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= LEAST_ASSIGN
    found = raw.select(
        "doc_id",
        F.filter(guarded(t, ASSIGN_START, ASSIGN), group_2).alias("assign"),
        guarded(t, "AKIA", ACCESS).alias("access"),
        guarded(t, HEX, HEX).alias("hex"),
        entropy_spans(t).alias("entropy"),
    )

    def ranked(kind: str, rank: int) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    overlaps = lambda x: F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return (
        found.withColumn("base", F.concat(*[ranked(k, i) for i, k in enumerate(KINDS[:3])]))
        .withColumn("added", F.filter(ranked("entropy", 3), lambda x: ~overlaps(x)))
        .select(
            "doc_id",
            *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
            F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
            joined(F.concat("base", "added")).alias("spans"),
            F.size("added").cast("long").alias("n_entropy"),
        )
    )


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
