"""Personal data: base patterns, and a character BiLSTM with CRF transitions trained in numpy from labelled spans.

Training spans come from the texts themselves: windows around matches of the base patterns, and the same windows with
the match rewritten in forms that the patterns miss (no plus sign, spelt-out signs), at most TRAIN_WINDOWS of them. The texts are a
sample of about SAMPLE_TEXTS distinct ones by a hash, larger where few of them hold personal data; only the first TRAIN_NEAR surroundings of signs in at most
TRAIN_DOCS of them reach the driver.

Tagging: every kind of personal data here holds a digit, an `@` or a spelt-out sign such as `[at]`, `(dot)` or `at` with a `dot` after the next word, so each of these in the whole
text is a trigger. Around a sign of an address the whole run of address characters on both sides belongs to the surroundings, however
long. Windows of WINDOW characters, half of each shared with the next, cover the surroundings of all triggers. The emissions of
overlapping windows are averaged, weighted towards each window's middle, and one Viterbi pass decodes the whole stretch. The network proposes;
tagged spans that overlap no base span, and that pass their kind's check (signs of an address, four numbers, Luhn, number of digits), are
added; a tagged address grows to the ends of its run first.

Nulls: a null text is empty and has no spans; a null doc_id is carried along. Repeated rows stay. Other columns are ignored by find_pii and kept by redact, whatever their names. An empty table gives an empty result. Without training matches
nothing is added. No text is cut: memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_chunks

KINDS = ("email", "ip", "card", "phone")
TRAIN_WINDOWS = 4000
TRAIN_DOCS = 1200
#: Surroundings of signs in one text of the sample that are trained on.
TRAIN_NEAR = 20
SAMPLE_TEXTS = 10_000
WINDOW, STRIDE, AROUND = 64, 32, 28
HIDDEN, EMBED, STEPS, BATCH, RATE = 16, 12, 400, 48, 0.02
#: Rewritten forms of a match that are trained on.
REWRITTEN = 4

# The base patterns. A run is taken whole and only from its beginning on, so each is walked once: a match that fails there
# fails from inside the run too.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Runs of more digits are part of no span.
MOST_DIGITS = 19
SIGN = re.compile("[0-9@]")
#: Signs of an address that are spelt out: in brackets of any kind, or as words of their own where both stand together.
AT = r"(?:[\[({<]\s?(?i:at?)\s?[\])}>]|(?<=\s)(?i:at)(?=\s[A-Za-z0-9-]++\s(?i:dot)\s))"
DOT = r"(?:[\[({<]\s?(?i:dot)\s?[\])}>]|(?<=\s)(?i:dot)(?=\s))"
TRIGGER = re.compile(f"(?<![0-9])[0-9]{{1,{MOST_DIGITS}}}+(?![0-9])|@|{AT}|{DOT}")
ADDRESS, SPELT = re.compile(f"@|{AT}"), re.compile(f"{AT}|{DOT}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that a long run of letters is walked once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        # what lies before this @ is no local part of a later one
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in code points."""
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return out


def ordered(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, KINDS.index(k), b, k) for a, b, k in spans))


# --- the tagger -------------------------------------------------------------------------------------------------------

#: Characters with a code of their own; small letters share a code, as do capitals, those of spelt-out signs, and all else.
_SIGNS = "0123456789@.-+()_% \n,:;#/*'\"[]"
_CODE = {c: i + 1 for i, c in enumerate(_SIGNS)}
_LETTER, _CAPITAL, _OTHER, _SPELT = len(_SIGNS) + 1, len(_SIGNS) + 2, len(_SIGNS) + 3, len(_SIGNS) + 4
VOCABULARY = _SPELT + 1
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]


_TABLE = np.array([_CODE.get(chr(i)) or (_LETTER if "a" <= chr(i) <= "z" else _CAPITAL if "A" <= chr(i) <= "Z" else _OTHER) for i in range(129)], np.int8)


def codes(text: str) -> np.ndarray:
    out = _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]
    for m in SPELT.finditer(text):
        out[m.start() : m.end()] = _SPELT
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, one LSTM each way, a linear layer to tag scores, and tag transitions."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        r = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"embed": r(VOCABULARY, EMBED), "out": r(2 * HIDDEN, len(TAGS)), "out_b": np.zeros(len(TAGS)), "move": np.zeros((len(TAGS), len(TAGS)))}
        for way in "fb":
            self.p |= {f"{way}_x": r(EMBED, 4 * HIDDEN), f"{way}_h": r(HIDDEN, 4 * HIDDEN), f"{way}_b": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}

    def _run(self, x: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """Hidden states of one direction; x is (batch, time, EMBED), already reversed for the backward one."""
        b, t, _ = x.shape
        drive = x @ self.p[f"{way}_x"] + self.p[f"{way}_b"]
        h, c, out = np.zeros((b, HIDDEN), x.dtype), np.zeros((b, HIDDEN), x.dtype), np.empty((b, t, HIDDEN), x.dtype)
        for k in range(t):
            z = drive[:, k] + h @ self.p[f"{way}_h"]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c_before = h, c
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[:, k] = h
            if keep is not None:
                keep.append((i, f, o, g, s, before, c_before))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        e = self.p["embed"][x]
        kept = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._run(e, "f", kept[0]), self._run(e[:, ::-1], "b", kept[1])[:, ::-1]], axis=2)
        if keep is not None:
            keep |= {"e": e, "h": h, "steps": kept}
        return h @ self.p["out"] + self.p["out_b"]

    def _back(self, grad: np.ndarray, way: str, steps: list, x: np.ndarray, g_out: dict) -> np.ndarray:
        b, t, _ = grad.shape
        dh, dc, dz_all = np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN)), np.empty((b, t, 4 * HIDDEN))
        for k in range(t - 1, -1, -1):
            i, f, o, g, s, before, c_before = steps[k]
            dh = dh + grad[:, k]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            g_out[f"{way}_h"] += before.T @ dz
            dz_all[:, k] = dz
            dh, dc = dz @ self.p[f"{way}_h"].T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        g_out[f"{way}_x"] += x.reshape(-1, EMBED).T @ flat
        g_out[f"{way}_b"] += flat.sum(axis=0)
        return dz_all @ self.p[f"{way}_x"].T

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the CRF over a batch of windows, and its gradient."""
        keep: dict = {}
        em, move = self.emissions(x, keep), self.p["move"]
        b, t, n = em.shape
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0]
        for k in range(1, t):
            alpha[:, k] = em[:, k] + lse(alpha[:, k - 1][:, :, None] + move[None], 1)
        for k in range(t - 2, -1, -1):
            beta[:, k] = lse(move[None] + (em[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        whole = lse(alpha[:, -1], 1)
        at, steps = np.arange(b)[:, None], np.arange(t)[None]
        loss = float((whole - em[at, steps, y].sum(axis=1) - move[y[:, :-1], y[:, 1:]].sum(axis=1)).mean())
        d_em = np.exp(alpha + beta - whole[:, None, None])
        d_em[at, steps, y] -= 1
        pairs = np.exp(alpha[:, :-1, :, None] + move[None, None] + (em + beta)[:, 1:, None, :] - whole[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["move"] = pairs
        flat = d_em.reshape(-1, n)
        g["out"], g["out_b"] = keep["h"].reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        dh = d_em @ self.p["out"].T
        de = self._back(dh[:, :, :HIDDEN], "f", keep["steps"][0], keep["e"], g)
        de = de + self._back(dh[:, ::-1, HIDDEN:], "b", keep["steps"][1], keep["e"][:, ::-1], g)[:, ::-1]
        np.add.at(g["embed"], x.ravel(), de.reshape(-1, EMBED))
        return loss, {k: v / b for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 7) -> float:
        """Adam over random batches; the last loss."""
        rng, loss = np.random.default_rng(seed), 0.0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            part = rng.choice(len(x), min(BATCH, len(x)), replace=False)
            loss, g = self.gradient(x[part], y[part])
            norm = np.sqrt(sum((a * a).sum() for a in g.values()))
            for k, a in g.items():
                a = a * min(1.0, 5 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                self.p[k] -= RATE * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return loss

    def light(self) -> Tagger:
        """The same network in single precision, for tagging."""
        out = object.__new__(Tagger)
        out.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return out

    def decode(self, em: np.ndarray) -> np.ndarray:
        """The best tags of one stretch."""
        t, n = em.shape
        back, score, move = np.zeros((t, n), np.int8), em[0], np.ascontiguousarray(self.p["move"].T)
        for k in range(1, t):
            every = score + move
            every.argmax(axis=1, out=(best := np.empty(n, np.int64)))
            back[k] = best
            score = every.max(axis=1) + em[k]
        tags = np.empty(t, np.int64)
        tags[-1] = score.argmax()
        for k in range(t - 1, 0, -1):
            tags[k - 1] = back[k, tags[k]]
        return tags


def stretches(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of all triggers. Those of a sign of an address hold the runs of address characters beside it."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = m.start(), m.end()
        if not m[0].isdigit():
            # what an earlier stretch holds, or an earlier run passed, is not walked again
            done = out[-1][1] if out else 0
            while a > done and text[a - 1].isspace() and m.start() - a < 2:
                a -= 1
            while a > done and text[a - 1] in LOCAL:
                a -= 1
            while b < len(text) and text[b].isspace() and b - m.end() < 2:
                b += 1
            b = max(b, min(done - AROUND, len(text)))
            while b < len(text) and text[b] in LOCAL:
                b += 1
        a, b = max(0, a - AROUND), min(len(text), b + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: What an address may go on with: letters of a domain, and dots, spelt out or not, before one.
ONWARD = re.compile(rf"(?:[A-Za-z0-9-]|\.(?=[A-Za-z0-9])|\s?{DOT}\s?(?=[A-Za-z0-9]))*+")
#: Characters between a tagged piece and the sign of its address.
NEAR = 6


def grown(text: str, a: int, b: int) -> tuple[int, int]:
    """A tagged address, as far as the runs on both sides of its first sign reach, over one blank beside a spelt-out one; as it is where it has no sign."""
    m = ADDRESS.search(text, max(0, a - NEAR), b + NEAR + WINDOW)
    if m is None or m.start() > b + NEAR:
        return a, b
    a, b = m.start(), m.end()
    if m[0] != "@":
        a -= text[a - 1 : a].isspace()
        b += text[b : b + 1].isspace()
    while a > 0 and text[a - 1] in LOCAL:
        a -= 1
    return a, ONWARD.match(text, b).end()


def whole_digits(text: str, a: int, b: int) -> tuple[int, int]:
    """A tagged number, up to the ends of its first and last runs of digits, with the bracket that its first run stands in."""
    while a > 0 and text[a - 1].isdigit() and text[a : a + 1].isdigit():
        a -= 1
    while b < len(text) and text[b].isdigit() and text[b - 1].isdigit():
        b += 1
    if text[a - 1 : a] == "(" and ")" in text[a:b]:
        a -= 1
    return a, b


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
#: Forms that a tagged span must have.
FITS = {
    "email": lambda s: bool(re.search(rf"[^\s@](@|\s?{AT}\s?)[A-Za-z0-9-]+(\.|\s?{DOT}\s?)[A-Za-z]", s)),
    "ip": lambda s: bool(re.fullmatch(r"[0-9]{1,3}([.,:-][0-9]{1,3}){3}", s)),
    "card": lambda s: 14 <= sum("0" <= c <= "9" for c in s) <= 19 and not re.search(r"[^0-9 ._/-]", s) and luhn(re.sub("[^0-9]", "", s)),
    "phone": lambda s: 10 <= sum("0" <= c <= "9" for c in s) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][ ()./0-9-]+[0-9]", s)) and bool(re.search(r"[ ()./-]", s)) and not re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s),
}


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans that the tagger finds in each text, with forms that fit."""
    tagger = tagger.light()
    parts = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for at in range(0, len(parts), 256):
        some = parts[at : at + 256]
        windows, homes, offsets = [], [], []
        for k, (i, a, b) in enumerate(some):
            c = codes(texts[i][a:b])
            for w in range(0, max(1, len(c) - STRIDE), STRIDE):
                piece = np.full(WINDOW, _OTHER, np.int8)
                piece[: len(c[w : w + WINDOW])] = c[w : w + WINDOW]
                windows.append(piece)
                homes.append(k)
                offsets.append(w)
        sums = [np.zeros((b - a, len(TAGS)), np.float32) for _, a, b in some]
        weights = [np.zeros((b - a, 1), np.float32) for _, a, b in some]
        for w0 in range(0, len(windows), 512):
            for em, k, w in zip(tagger.emissions(np.array(windows[w0 : w0 + 512])), homes[w0 : w0 + 512], offsets[w0 : w0 + 512], strict=True):
                n = min(WINDOW, len(sums[k]) - w)
                sums[k][w : w + n] += em[:n] * _WEIGHT[:n, None]
                weights[k][w : w + n] += _WEIGHT[:n, None]
        for (i, a, _), s, w in zip(some, sums, weights, strict=True):
            tags, start, kind = tagger.decode(s / w), 0, -1
            for k, tag in enumerate([*tags, 0]):
                if kind >= 0 and tag != 2 * kind + 2:
                    span = (a + start, a + k)
                    span = grown(texts[i], *span) if KINDS[kind] == "email" else whole_digits(texts[i], *span)
                    if FITS[KINDS[kind]](texts[i][span[0] : span[1]]) and not (out[i] and span[0] < out[i][-1][1]):
                        out[i].append((*span, KINDS[kind]))
                    kind = -1
                if tag % 2 == 1:
                    kind, start = int(tag) // 2, k
    return out


def rewritten(found: str, kind: str, rng: np.random.Generator) -> str | None:
    """A match in a form that the base patterns miss, its letters and digits drawn anew; None for kinds with no such form."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    letters, numbers = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    anew = lambda t: "".join(pick(*letters) if c.isalpha() else pick(*numbers) if c.isdigit() else c for c in t)
    digits = anew("".join(c for c in found if "0" <= c <= "9"))
    if kind == "phone":
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return pick(f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")
    if kind == "card":
        return ".".join(digits[j : j + 4] for j in range(0, len(digits), 4))
    if kind == "email":
        local, domain = found.split("@", 1)
        labels = domain.split(".")
        labels = [anew(x) for x in labels[-int(rng.integers(2, len(labels) + 1)) : -1]] + [pick(labels[-1], "com", "org", "net", "de")]
        local = pick(anew(local), anew(local.split(".")[0]), anew(local).replace(".", "_"))
        blank = pick("", " ")
        at, dot = blank + pick("[at]", "(at)", "[AT]", "(At)", "{at}", "<at>") + blank, pick(".", ".", ".", blank + pick("[dot]", "(dot)", "[DOT]", "{dot}", "<dot>") + blank)
        if rng.integers(4) == 0:
            at, dot = pick(" at ", " at ", " AT "), pick(" dot ", " dot ", " DOT ")
        return local + at + dot.join(labels)
    return None


def training_windows(texts: list[str], most: int = TRAIN_WINDOWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows around triggers with their tags: as they stand, and with matches rewritten in forms that the patterns miss."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def add(text: str, spans: list[tuple[int, int, str]], middle: int) -> None:
        a = max(0, middle - int(rng.integers(8, WINDOW - 8)))
        c = codes(text[a : a + WINDOW])
        x, y = np.full(WINDOW, _OTHER), np.zeros(WINDOW, np.int64)
        x[: len(c)] = c
        for s, e, k in spans:
            for p in range(max(s, a), min(e, a + WINDOW)):
                y[p - a] = 2 * KINDS.index(k) + (1 if p == s else 2)
        xs.append(x)
        ys.append(y)

    for text in texts:
        spans = base_spans(text)
        taken = {p for s, e, _ in spans for p in range(s, e)}
        free = [m.start() for m in SIGN.finditer(text) if m.start() not in taken]
        for p in free[:: max(1, len(free) // 4)]:
            add(text, spans, p)
        for s, e, k in spans:
            add(text, spans, (s + e) // 2)
            left, right = text[max(0, s - WINDOW) : s], text[e : e + WINDOW]
            for _ in range(REWRITTEN):
                new = rewritten(text[s:e], k, rng)
                if new:
                    add(left + new + right, [(len(left), len(left) + len(new), k)], len(left) + int(rng.integers(len(new))))
        if len(xs) >= most:
            break
    return np.array(xs[:most]).reshape(-1, WINDOW), np.array(ys[:most]).reshape(-1, WINDOW)


def fit(docs: DataFrame) -> Tagger | None:
    """A tagger trained on the surroundings of triggers in at most TRAIN_DOCS texts of a sample."""
    near = F.regexp_extract_all("text", F.lit("(?s).{0,64}[0-9@].{0,96}"), F.lit(0))
    holds = F.col("text").rlike(r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]{14}|\+[0-9]")
    n, fine = docs.where("text is not null").count(), 1 << 30
    share = min(1.0, SAMPLE_TEXTS / max(n, 1))
    while True:
        # equal texts have one hash: a group of copies is in or out as one, and counts once
        some = docs.select("text", F.xxhash64("text", F.lit(29)).alias("h")).where(F.pmod("h", F.lit(fine)) < int(share * fine))
        texts = some.where(holds).select("h", F.array_join(F.slice(near, 1, TRAIN_NEAR), " ").alias("near")).groupBy("h").agg(F.min("near").alias("near"))
        rows = texts.orderBy("h").limit(TRAIN_DOCS).collect()
        if len(rows) >= TRAIN_DOCS or share >= 1:
            break
        share = min(1.0, 8 * share)
    x, y = training_windows([r["near"] for r in rows])
    if not len(x) or not y.any():
        return None
    tagger = Tagger()
    tagger.train(x, y)
    return tagger


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """Base and added spans of each text."""
    base = [base_spans(t) for t in texts]
    if tagger is None:
        return [(b, []) for b in base]
    added = tagged_spans(tagger, texts)
    return [(b, [s for s in a if not any(s[0] < e and c < s[1] for c, e, _ in b)]) for b, a in zip(base, added, strict=True)]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, for every row of `docs`."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, spans = [], []
            for base, added in all_spans(sent.value, [t.decode() for t in texts]):
                for k in KINDS:
                    counts[k].append(sum(x[2] == k for x in base))
                digests.append(hashlib.sha256(ordered(base).encode()).hexdigest())
                spans.append(ordered(base + added))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each span of personal data replaced by its kind in angle brackets; the first of overlapping spans counts.

    n_chars, where there is such a column, follows the new text. A null text stays null."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            strings, out = [t.decode() for t in texts], []
            for t, (base, added) in zip(strings, all_spans(sent.value, strings), strict=True):
                pieces, done = [], 0
                for a, _, b, k in sorted((a, KINDS.index(k), b, k) for a, b, k in base + added):
                    if a >= done:
                        pieces += [t[done:a], f"<{k.upper()}>"]
                    done = max(done, b)
                out.append("".join([*pieces, t[done:]]))
            old = part.column("text").is_null().to_pylist()
            columns = list(part.columns)
            columns[place] = pa.array([None if gone else t for gone, t in zip(old, out, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    kinds = dict(docs.dtypes)
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else out


def op5_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
