import difflib
import random
import re

from litomics.operators import axis

SCHEMA = "id long, title string, summary string, disease_raw array<string>"
SUBJECTS = "id long, descriptor string, is_major boolean"


def clean(t):
    return " ".join(re.sub(r"[^\w\s\-]", " ", (t or "").lower()).split())


def runs(text):
    words = re.findall(r"[A-Za-z0-9][A-Za-z0-9\-]*[A-Za-z0-9]|[A-Za-z0-9]", text)
    for i in range(len(words)):
        for n in range(1, 5):
            g = [w.lower() for w in words[i : i + n]]
            if len(g) == n and any(w not in axis.BLOCKED for w in g) and (n > 1 or len(g[0]) >= 6):
                yield " ".join(g)


def plain(datasets, subjects, names):
    refs = {a: {} for a in axis.AXES}
    for a, name in names:
        refs[a][clean(name)] = min(name, refs[a].get(clean(name), name))

    def match(norm, kind):
        for a in axis.AXES:
            if norm in refs[a]:
                yield a, 1.0, "exact", refs[a][norm]
            elif kind == "whole":
                tokens = [w for w in norm.split(" ") if len(w) >= 5][:3]
                all_names = {(clean(n), n) for b, n in names if b == a}
                counts = [(sum(w in n.split(" ") for n, _ in all_names), k, w) for k, w in enumerate(tokens)]
                counts = [c for c in counts if c[0]]
                if counts:
                    ratio, n, name = min((-difflib.SequenceMatcher(None, norm, n, autojunk=False).ratio(), n, name) for n, name in all_names if min(counts)[2] in n.split(" "))
                    if -ratio >= axis.LEAST[a]:
                        yield a, -ratio, "fuzzy", name

    out = {}
    for i, title, summary, raw in datasets:
        terms = [((x or "").strip(), "whole") for x in raw or []]
        terms += [(d, "whole") for _, d in sorted({(not major, d) for j, d, major in subjects if j == i})]
        title, summary = (title or "").strip(), (summary or "").strip()[:200]
        terms += [(g, "gram") for g in runs(title)] + [(title, "whole")] + [(g, "gram") for g in runs(summary)] + [(summary, "whole")]
        seen, best = {}, {}
        for term, kind in terms:
            norm = clean(term)
            if norm and norm not in seen:
                seen[norm] = kind
                for a, score, method, name in match(norm, kind):
                    if a not in best or score > best[a][0]:
                        best[a] = (score, method, name, kind)
        m, f = (best.get(a) for a in axis.AXES)
        if m and f and m[3] == f[3] == "gram":
            if clean(m[2]) in clean(f[2]):
                m = None
            elif clean(f[2]) in clean(m[2]):
                f = None
        kind = "mixed" if m and f else "monogenic" if m else "multifactorial" if f else "indeterminate"
        method = m[1] if m and m[0] >= (f[0] if f else 0) else f[1] if f else "none"
        out[i] = (kind, round(max(m[0] if m else 0, f[0] if f else 0), 9), method, len(seen), m and m[2], f and f[2])
    return out


def check(spark, datasets, subjects, names):
    rows = axis.classify(spark.createDataFrame(datasets, SCHEMA), spark.createDataFrame(subjects, SUBJECTS), spark.createDataFrame(names, "axis string, name string")).collect()
    got = {r["id"]: (r["axis"], round(r["score"], 9), r["method"], r["n_candidates"], r["monogenic_name"], r["multifactorial_name"]) for r in rows}
    want = plain(datasets, subjects, names)
    assert len(rows) == len(datasets) and got == want, [(i, got.get(i), w) for i, w in want.items() if got.get(i) != w][:3]
    return got


NAMES = [("monogenic", "Cystic fibrosis"), ("monogenic", "Fibrosis"), ("multifactorial", "Pulmonary fibrosis"), ("multifactorial", "Type 2 diabetes mellitus"), ("multifactorial", "Asthma"), ("monogenic", "Marfan syndrome")]


def test_decisions(spark):
    datasets = [
        (1, "Lungs in cystic fibrosis patients", None, None), (2, "A study of pulmonary fibrosis", "", None), (3, "Marfan syndrome and asthma", None, None), (4, "Expression of genes in mouse cells", "the data", []),
        (5, None, None, ["type II diabetes mellitus"]), (6, "Nothing here", None, ["Marfan's syndrome", "asthma"]), (7, None, None, None), (8, "cell death", "x" * 300 + " asthma", None), (9, "Asthma", None, [None, ""]),
    ]
    subjects = [(4, "Asthma", False), (4, "Marfan Syndrome", True), (4, "Asthma", False), (99, "Asthma", True)]
    got = check(spark, datasets, subjects, NAMES)
    assert got[1][0] == "monogenic" and got[1][4] == "Cystic fibrosis"
    # "fibrosis" alone is part of the longer finding of the other axis
    assert got[2][0] == "multifactorial" and got[2][4] is None
    assert got[3][0] == got[4][0] == "mixed" and got[5][2] == "fuzzy" and got[7][0] == got[8][0] == "indeterminate"


def test_against_a_plain_version(spark):
    rng = random.Random(8)
    words = "cystic fibrosis pulmonary marfan syndrome asthma type 2 diabetes mellitus familial study of cells mouse gene expression in early-onset".split()
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    names = NAMES + [(rng.choice(axis.AXES), phrase(rng.randrange(1, 4))) for _ in range(30)]
    datasets = [(i, phrase(rng.randrange(0, 9)), rng.choice([None, phrase(40)]), rng.choice([None, [phrase(2), phrase(3)]])) for i in range(60)]
    subjects = [(rng.randrange(60), phrase(2), rng.random() < 0.5) for _ in range(40)]
    check(spark, datasets, subjects, names)


def test_every_name_of_a_common_token_is_met(spark):
    """More names than 200 hold a term's rarest token, on either axis, and the best ones stand behind them."""
    names = [("monogenic", f"Dystrophy {k:03d}") for k in range(260)] + [("multifactorial", f"Retinal dystrophy {k:03d}") for k in range(260)]
    datasets = [(1, None, None, ["dystrophy 2599"]), (2, None, None, ["retinal dystrophies 257"]), (3, None, "x", [f"dystrophy {k}" for k in ("2558", "25")]), (4, "Retinal dystrophy 3258", None, None)]
    got = check(spark, datasets, [], names)
    assert got[1][4] == "Dystrophy 259" and got[2][5] == "Retinal dystrophy 257"
