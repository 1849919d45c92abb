"""English lexemes for full-text search: lower-case words without stop words, reduced by the Snowball English rules."""

from __future__ import annotations

import re

VOWELS = frozenset("aeiouy")

# Words that are never lexemes.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
# Words with a stem of their own, words left alone, words left alone after their plural is gone, and beginnings whose first region is known.
IRREGULAR = dict(
    w.split(">") for w in "skis>ski skies>sky dying>die lying>lie tying>tie idly>idl gently>gentl ugly>ugli early>earli only>onli singly>singl sky>sky news>news howe>howe atlas>atlas cosmos>cosmos bias>bias andes>andes".split()
)
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
OPENINGS = ("gener", "commun", "arsen")
# Suffixes and what they become; in the first region for steps 2 and 3, in the second for step 4.
STEP_2 = dict(
    s.split(">")
    for s in (
        "tional>tion enci>ence anci>ance abli>able entli>ent izer>ize ization>ize ational>ate ation>ate ator>ate alism>al aliti>al alli>al fulness>ful ousli>ous "
        "ousness>ous iveness>ive iviti>ive biliti>ble bli>ble fulli>ful lessli>less ogi>og li>"
    ).split()
)
STEP_3 = dict(s.split(">") for s in "tional>tion ational>ate alize>al icate>ic iciti>ic ical>ic ful> ness> ative>".split())
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())
BEFORE_LI = frozenset("cdeghkmnrt")

WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def after_first_pair(word: str, start: int) -> int:
    """The place after the first consonant that follows a vowel, from `start` on; the word's end without one."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def longest(word: str, suffixes) -> str | None:
    """The longest of the suffixes that the word ends with."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def ends_short(word: str) -> bool:
    """Whether a word ends with a short syllable; Y is a consonant."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS and word[-1] not in "wxY"


def has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def without_plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        return w[:-1]
    return w


def without_participle(w: str, r1: int) -> str:
    s = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s is None:
        return w
    stem = w[: -len(s)]
    if s.startswith("eed"):
        return stem + "ee" if len(stem) >= r1 else w
    if not has_vowel(stem):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-2:] in DOUBLES:
        return stem[:-1]
    return stem + "e" if ends_short(stem) and r1 >= len(stem) else stem


def replaced(w: str, table: dict[str, str], r1: int, r2: int) -> str:
    s = longest(w, table)
    if s is None or len(w) - len(s) < r1:
        return w
    before = w[: -len(s)]
    if s == "li" and before[-1:] not in BEFORE_LI or s == "ogi" and not before.endswith("l") or s == "ative" and len(before) < r2:
        return w
    return before + table[s]


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word.removeprefix("'"))
    opening = next((o for o in OPENINGS if w.startswith(o)), None)
    r1 = len(opening) if opening else after_first_pair(w, 0)
    r2 = after_first_pair(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    w = without_plural(w)
    if w in KEPT:
        return w
    w = without_participle(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = replaced(w, STEP_2, r1, r2)
    w = replaced(w, STEP_3, r1, r2)
    s = longest(w, STEP_4)
    if s is not None and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not ends_short(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexemes(text: str, memo: dict[str, str | None] | None = None) -> list[str]:
    """The lexemes of a text in order: a compound with hyphens is one, and so is each of its parts; words with digits stay as they are. Apostrophes part words."""
    memo = {} if memo is None else memo
    out = []
    for m in WORD.finditer(text.lower()):
        whole = m[0]
        for w in (whole, *whole.split("-")) if "-" in whole else (whole,):
            if w not in memo:
                memo[w] = None if w in STOP_WORDS else w if any(c.isdigit() for c in w) else "-".join([*w.split("-")[:-1], stem(w.split("-")[-1])])
            if memo[w]:
                out.append(memo[w])
    return out
