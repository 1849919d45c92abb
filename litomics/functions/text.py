"""Text functions on columns: sentences, term matches, identifiers, n-grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HELD = "\ue000"  # stands for a dot that ends no sentence

# Abbreviations whose dot ends no sentence, letter case ignored.
ABBREVIATIONS = (
    "approx cf ca vs fig figs eq eqs ref refs sec tab tabs sup supp suppl no p pp dr st prof mr ms mrs jr sr "
    "mg μg ng pg ml μl nl kg g nm μm mm cm kda da"
).split()


def held_dots(text: Column) -> Column:
    """The text with the dots of abbreviations, decimals and acronyms replaced by HELD."""
    out = F.trim(text)
    out = F.regexp_replace(out, r"(?i)\b(e|i)\.(g|e)\.", f"$1{HELD}$2{HELD}")
    out = F.regexp_replace(out, r"(?i)\b(et al)\.", f"$1{HELD}")
    out = F.regexp_replace(out, rf"(?iU)\b({'|'.join(ABBREVIATIONS)})\.", f"$1{HELD}")
    out = F.regexp_replace(out, r"([0-9])\.(?=[0-9])", f"$1{HELD}")
    out = F.regexp_replace(out, r"([A-Za-z])\.(?=[A-Za-z]\.)", f"$1{HELD}")
    return F.regexp_replace(out, rf"({HELD}[A-Za-z])\.", f"$1{HELD}")


def sentences(text: Column) -> Column:
    """Sentences in order, without empty ones; null and empty texts give an empty array."""
    parts = F.split(held_dots(F.coalesce(text, F.lit(""))), r"(?<=[.!?;])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.translate(s, HELD, "."))), lambda s: s != "")


def plain_sentences(text: Column) -> Column:
    """Sentences after any of . ! ? and blanks, without protection; the splitter of subject headings."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def mentions(sentence: Column, term: Column) -> Column:
    """Whether a sentence holds the term as a whole word, letter case ignored; the term is literal."""
    return F.regexp_like(sentence, F.concat(F.lit(r"(?iU)\b\Q"), term, F.lit(r"\E\b")))


def rs_numbers(text: Column) -> Column:
    """rs identifiers of variants in lower case, at most 20 characters each."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(rs[0-9]+)\b"), F.lit(1)), lambda x: F.lower(x)), lambda x: F.length(x) <= 20)


def normal_name(name: Column) -> Column:
    """A trait's name for comparison: lower case, punctuation but the hyphen as blanks, blanks single."""
    out = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s\-]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once a row: inside lambdas Spark works a column out again at each call, but not a lambda's own variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_list(text: Column) -> Column:
    """Words of letters, digits, apostrophes and hyphens."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)([\w'\-]+)"), F.lit(1))


def ngrams(text: Column, most: int = 4, blocked: tuple[str, ...] = (), least_chars: int = 6) -> Column:
    """Distinct normalised 1- to `most`-grams that may name a disease.

    Dropped: blocked grams, grams of blocked words alone, single words shorter than `least_chars`."""
    no = F.array(*[F.lit(b) for b in blocked]) if blocked else F.array().cast("array<string>")
    # words are normalised once, and each tells whether it alone is blocked
    words = F.filter(F.transform(word_list(text), lambda w: normal_name(w)), lambda w: w != "")

    def of(n: int, words: Column, free: Column) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        grams = F.transform(F.filter(starts, lambda i: F.exists(F.slice(free, i, n), lambda x: x)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.filter(grams, lambda g: ~F.array_contains(no, g) & ((F.lit(n) > 1) | (F.length(g) >= least_chars)))

    every = lambda words, free: F.array_distinct(F.flatten(F.array(*[of(n, words, free) for n in range(1, most + 1)])))
    return bound(words, lambda words: bound(F.transform(words, lambda w: ~F.array_contains(no, w)), lambda free: every(words, free)))


def pmid(raw: Column) -> Column:
    """Digits of a PubMed id, 1 to 8 of them; else null."""
    found = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?i)^\s*(?:pmid[:\s]*)?([0-9]{1,8})\s*$", 1)
    return F.nullif(found, F.lit(""))


def doi(raw: Column) -> Column:
    """A DOI in lower case without resolver or prefix; else null."""
    found = F.regexp_extract(F.lower(F.trim(F.coalesce(raw, F.lit("")))), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.[0-9]{4,9}/\S+)$", 1)
    return F.nullif(found, F.lit(""))


def bioproject(raw: Column) -> Column:
    """A BioProject accession in upper case; else null."""
    found = F.regexp_extract(F.upper(F.coalesce(raw, F.lit(""))), r"(PRJ[A-Z]{2}[0-9]+)", 1)
    return F.nullif(found, F.lit(""))
