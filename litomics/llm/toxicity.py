"""Toxicity by a noisy channel: Viterbi-decode disguised words under a character model, then score the restored text.

The character model is a trigram model counted over all documents. A word is disguised if digits or signs stand among its
letters, a letter repeats three times or more, every letter stands twice, or single characters stand in a row, whatever stands between them. Its lattice has, for each character, the letters
it may stand for, the skip of a separator, and the skip of a repeated letter; the best path under channel and model replaces it. Words
with one path only (letters, no repeats) are what they are, without a lattice. Signs at a word's edge may be letters or punctuation, so
such a word is decoded with and without them. Runs of one character are folded to three first. A word cut into pieces of several letters by blanks is not put together.

Word weights and the final logistic function are learned from at most TRAIN_ROWS labelled documents, taken by a hash of
doc_id, whose crc32(doc_id) mod 4 is not 2. Labels, lang, source and doc_id are no inputs of a score. Their texts stay in tasks: the driver
gets the MOST_WORDS heaviest words and three numbers for each of these documents. MOST_WORDS is the size of the classifier and MOST_LETTERS the length of its longest word, not cuts of any text.

Nulls: a null text is empty and gets the score of a text without known words; a null doc_id counts as empty text in the
fold; null labels are no labels. Without labels of both kinds every score is 0. Repeated rows stay. An empty table gives an empty
result. No text is cut.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, small_batches, staged, table, text_chunks

TRAIN_ROWS = 12_000
#: Words with a weight: the classifier's size; the heaviest stay.
MOST_WORDS = 5000
LEAST_DOCS = 3
#: Standard errors taken off a log odds ratio before it counts.
CAUTION = 2.5
THRESHOLD = 0.3
#: Letters of the longest word that can have a weight. A seen word of any length is decoded if a reading of it can be that short.
MOST_LETTERS = 64
#: Longer words are decoded anew each time, so that the memo stays small.
MEMO_LONGEST = 64

# What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou"}
SEPARATORS = set(".-_*~ '")

N_CLASSES = 29  # space, a-z, other ASCII, other
_CLASS = np.full(256, 28, np.uint32)
_CLASS[:128] = 27
_CLASS[[*range(9, 14), 32]] = 0
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = _i + 1

_FOLD = bytearray(range(256))
for _i in range(128):
    _c = chr(_i).lower()
    _FOLD[_i] = ord(_c) if _c.isalpha() else 32
FOLD = bytes(_FOLD)
LOWER = bytes((c + 32 if 65 <= c <= 90 else c) for c in range(256))

#: Single characters in a row, with any signs and blanks between them, as many as there are. Characters and what stands between them share no sign, so there is one way only to read a row.
ONE, BETWEEN = "[a-z0-9@$!*#](?![a-z0-9@$\x80-\U0010ffff])", "[^a-z0-9@$!*#\x80-\U0010ffff]"
SPACED = re.compile(rf"(?<!\S){ONE}(?:{BETWEEN}++{ONE}){{2,}}+")
BETWEEN = re.compile(BETWEEN)
OUTER = ".,;:?\"'()[]{}<>%&=/\\"
#: Signs that are letters or punctuation at a word's beginning and end.
OPENING, CLOSING = "(", "!*#$|+("
SIGN = re.compile(r"[0-9@$!|+(*#._~'-]")
LETTER = re.compile("[a-z]")
STRETCHED = re.compile(r"([a-z])\1\1")
#: Every letter twice.
DOUBLED = re.compile(r"(?:([a-z])\1){3,}+\Z")

#: Words that `disguised` has no reading for, at a glance: letters with punctuation behind them, no letter three times in a row, not every letter twice.
PLAIN = re.compile(r"(?!(?:([a-z])\1){3})(?:([a-z])(?!\2\2)|[\x80-\U0010ffff])+[.,;:?\"')\]}>]*\Z")


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over every text; N_CLASSES ** 3 numbers, whatever the input."""
    n = N_CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n**3, np.int64)
        for _, texts in text_chunks(batches):
            c = _CLASS[np.frombuffer(b"  ".join([b" ", *texts, b" "]), np.uint8)]
            total += np.bincount(c[:-2] * (n * n) + c[1:-1] * n + c[2:], minlength=n**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])

    out = np.zeros(n**3)
    for r in docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out


class CharModel:
    """Interpolated trigram model of lower-case letters; log probabilities."""

    def __init__(self, counts: np.ndarray) -> None:
        c = counts.reshape(N_CLASSES, N_CLASSES, N_CLASSES)
        two, one = c.sum(axis=0), c.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + N_CLASSES)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (c + 20 * p2[None]) / (c.sum(axis=2, keepdims=True) + 20)
        self.log = np.log(p3).tolist()

    @staticmethod
    def code(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27 if c < "\x80" else 28

    def decode(self, seen: str) -> str:
        """The best word behind `seen`: Viterbi over states of the last two letters."""
        start = (0, 0)
        # a path's word is linked from its last letter back, so that a step takes the same time in words of any length
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {start: (0.0, None)}
        last, closing = "", len(seen.rstrip("!"))
        for i, c in enumerate(seen):
            options: list[tuple[str, float]] = []
            if "a" <= c <= "z" or c >= "\x80":
                options.append((c, 0.0))
                if c == last:
                    options.append(("", -0.7))
            else:
                options += [(x, -1.5) for x in LEET.get(c, "")]
                # a closing exclamation mark may be one
                if c in SEPARATORS or c == last or i >= closing:
                    options.append(("", -0.7))
                if not options or c.isdigit():
                    options.append((c, -3.0))
            last = c
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, word) in best.items():
                row = self.log[a][b]
                for letter, cost in options:
                    if letter == "" and word is None:
                        continue
                    if letter == "":
                        state, value, grown = (a, b), score + cost, word
                    else:
                        k = self.code(letter)
                        state, value, grown = (b, k), score + cost + row[k], (word, letter)
                    if state not in new or value > new[state][0]:
                        new[state] = (value, grown)
            if new:
                best = new
        word = max(((score + self.log[a][b][0], word) for (a, b), (score, word) in best.items()), key=lambda x: x[0])[1]
        letters = []
        while word is not None:
            word, letter = word
            letters.append(letter)
        return "".join(reversed(letters))


def squeezed(word: str) -> str:
    """A word whose letter runs of three or more are one."""
    return re.sub(r"(.)\1{2,}", r"\1", word)


def disguised(raw: str) -> set[str]:
    """The readings of a word between blanks that have to be decoded: without signs at its edges, and with those that may be letters."""
    if not LETTER.search(raw) or raw.isalpha() and not STRETCHED.search(raw) and not DOUBLED.match(raw):
        return set()
    bare = raw.strip(OUTER)
    left = raw.lstrip(OUTER.replace(OPENING, ""))
    out = set()
    for w in (bare, left.rstrip(OUTER)):
        w = w.rstrip(OUTER.replace("(", ""))
        out |= {w, w.rstrip(CLOSING + OUTER)}
    out = {w for w in out if LETTER.search(w) and (not w.isalpha() and SIGN.search(w) or STRETCHED.search(w) or DOUBLED.match(w))}
    return {re.sub(r"(.)\1{3,}", r"\1\1\1", w) for w in out} | {w[::2] for w in out if DOUBLED.match(w)}


def readings(seen: set[str], model: CharModel) -> frozenset[bytes]:
    out = set()
    for w in seen:
        word = model.decode(w)
        if word:
            out |= {word.encode(), squeezed(word).encode()}
    return frozenset(out)


def least_letters(seen: str) -> int:
    """Letters that any reading of a word has at least: what may not be skipped."""
    closing = len(seen.rstrip("!"))
    return sum(c != last and ("a" <= c <= "z" or c >= "\x80" or c not in SEPARATORS and i < closing) for i, (c, last) in enumerate(zip(seen, " " + seen)))  # noqa: B905


def restored_words(text: bytes, model: CharModel, memo: dict[str, frozenset[bytes]], longest: int | None = None) -> set[bytes]:
    """The distinct words of a text, disguised ones replaced by what they stand for (and kept as they stand).

    With `longest`, words all of whose readings have more letters are not decoded: none of them can be a word of that length."""
    words = set(text.translate(FOLD).split())
    line = text.translate(LOWER).decode("utf-8", "replace")
    fits = lambda w: longest is None or len(w) <= longest or least_letters(w) <= longest
    for w in {BETWEEN.sub("", m[0]) for m in SPACED.finditer(line)}:
        # a row of bullets or digits alone may stand for anything and so says nothing
        if LETTER.search(w) and fits(w):
            words |= readings({w}, model)
    for w in set(line.split()):
        if PLAIN.match(w):
            continue
        found = memo.get(w)
        if found is None:
            found = readings({x for x in disguised(w) if fits(x)}, model)
            if len(w) <= MEMO_LONGEST:
                if len(memo) > 50_000:
                    memo.clear()
                memo[w] = found
        if found:
            words |= found
    return words


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


class Scorer:
    """Weights of words and the logistic function over a text's summed weights."""

    def __init__(self, model: CharModel, weights: dict[bytes, float], coefficients: np.ndarray) -> None:
        self.model, self.weights, self.coefficients = model, weights, coefficients
        self.longest = max(map(len, weights), default=0)

    def inputs(self, bag: set[bytes]) -> tuple[float, float, float]:
        return _inputs(bag, self.weights)

    def score(self, text: bytes, memo: dict[str, frozenset[bytes]]) -> float:
        z = float(np.dot(self.coefficients, self.inputs(restored_words(text, self.model, memo, self.longest))))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _inputs(bag: set[bytes], weights: dict[bytes, float]) -> tuple[float, float, float]:
    hits = [weights[w] for w in bag & weights.keys()]
    return (max(hits, default=0.0), min(sum(hits), 20.0), 1.0)


def weights_of(bags: DataFrame, n_toxic: int, n_clean: int) -> dict[bytes, float]:
    """Log odds ratios of words, less CAUTION standard errors, of the MOST_WORDS heaviest ones."""
    words = bags.select("toxic", F.explode("bag").alias("word")).where(F.octet_length("word") <= MOST_LETTERS).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    ratio = F.log(((k + 0.1) / (n_toxic + 0.2)) / ((n - k + 0.1) / (n_clean + 0.2)))
    weight = ratio - CAUTION * F.sqrt(1 / (k + 0.5) + 1 / (n - k + 0.5))
    heavy = words.where((F.col("n") >= LEAST_DOCS) & (F.col("k") > 0)).select("word", weight.alias("weight")).where("weight > 0.8")
    return {bytes(r["word"]): r["weight"] for r in heavy.orderBy(F.desc("weight"), "word").limit(MOST_WORDS).collect()}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    """The character model over all documents; weights from at most `train_rows` labelled ones outside the held-out fold."""
    model = CharModel(trigram_counts(docs))
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col("doc_id")) != 2))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(train_rows)
    )
    # of rows that share a doc_id one is learned from
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, frozenset[bytes]] = {}
        for part, texts in text_chunks(batches):
            bags = [sorted(restored_words(t, sent.value, memo, MOST_LETTERS)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(bags, pa.list_(pa.binary()))], names=["toxic", "bag"])

    bags = staged(rows.select("text", "toxic").mapInArrow(restore, "toxic int, bag array<binary>"), "bags")
    n, n_toxic = bags.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return Scorer(model, {}, np.array([0.0, 0.0, -50.0]))
    weights = weights_of(bags, n_toxic, n - n_toxic)
    heavy = docs.sparkSession.sparkContext.broadcast(weights)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([_inputs(set(b), heavy.value) for b in batch.column("bag").to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(3)), batch.column("toxic")], names=["a", "b", "c", "y"])

    x = bags.mapInArrow(inputs, "a double, b double, c double, y int").toPandas()  # train_rows rows of four numbers
    discard(bags)
    return Scorer(model, weights, _logistic(x[["a", "b", "c"]].to_numpy(float), x["y"].to_numpy(float)))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, memo = sent.value, {}
        for part, texts in text_chunks(batches):
            scores = np.array([scorer.score(t, memo) for t in texts], float)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


def op4_viterbi_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
