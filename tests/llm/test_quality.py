import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from litomics.llm import quality

from .cases import docs, sample


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_counts_against_plain(spark):
    frame = docs(spark, [*sample("documents"), "a b c a b c d\n\n é é\n é é\n", "x y\n \nx y\n# | <é>"])
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.judge(frame, labels).collect()
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert len(rows) == frame.count()
    for r in rows:
        assert tuple(r)[1:7] == plain(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(frame.limit(0), labels).collect() == []
    none = quality.judge(frame, labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in none)


def test_forest_isolates():
    rng = np.random.default_rng(0)
    forest = quality.IsolationForest(rng.normal(size=(500, 4)))
    inside, outside = forest.path_lengths(rng.normal(size=(200, 4)) * 0.5), forest.path_lengths(np.full((5, 4), 4.0))
    assert outside.max() < inside.min()


def walked(tree, row, at=0):
    feature, value, children, length = tree
    if feature[at] < 0:
        return length[at]
    return walked(tree, row, children[at][int(row[feature[at]] >= value[at])])


def test_path_length_is_the_mean_over_trees():
    rng = np.random.default_rng(1)
    rows = rng.gamma(0.5, size=(300, 5))
    forest = quality.IsolationForest(rows, np.array([1.0, 0, 2, 0, 1]))
    assert not any(f in (1, 3) for t in forest.trees for f in t[0])
    got = forest.path_lengths(rows[:50])
    assert np.allclose(got, [np.mean([walked(t, r) for t in forest.trees]) for r in rows[:50]])


def test_told_apart_against_all_pairs():
    rng = np.random.default_rng(2)
    length, bad = rng.integers(0, 9, 80).astype(float), rng.random(80) < 0.3
    pairs = [(b < g) + 0.5 * (b == g) for b in length[bad] for g in length[~bad]]
    assert abs(quality.told_apart(length, bad) - np.mean(pairs)) < 1e-12


def test_path_lengths_alone_tell_held_out_rows(spark):
    """Fitted on one half of the labelled rows; on the other half, path length against threshold is the whole verdict."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    forest, least = quality.fit(d, half)
    assert set(vars(forest)) == {"most", "trees"}
    rows = quality.measured(d.join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id").select("doc_id", "text", "quality")).toPandas()
    counts = rows[[*quality.COUNTS, *quality.EXTRA]].to_numpy(np.int64)
    past = ~quality.base_failed(counts)
    gone = forest.path_lengths(quality.features(counts[past])) < least
    good = rows["quality"].to_numpy()[past] == 1
    assert (~good).sum() > 100 and gone[~good].mean() >= 0.9 and gone[good].mean() <= 0.02


def test_without_bad_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(d, labels.where("quality = 1")).join(labels, "doc_id").where("not base_failed and quality = 1").collect()
    assert sum(not r["kept"] for r in rows) <= 0.01 * len(rows)


def test_labelled_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(d, labels).join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns
    want = sorted(r["doc_id"] for r in quality.judge(d, labels).where("kept").collect())
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == want


def test_counts_tell_apart_and_part_as_rows_do():
    rng = np.random.default_rng(4)
    step, bad = rng.integers(0, 40, 500), rng.random(500) < 0.2
    each = np.unique(step)
    n_bad, n_good = (np.array([(step[m] == x).sum() for x in each]) for m in (bad, ~bad))
    assert abs(quality.told_apart_by_counts(n_bad, n_good) - quality.told_apart(step.astype(float), bad)) < 1e-12
    least = quality.least_kept(each, n_bad, n_good) * quality.STEPS
    gain = lambda e: (step[bad] < e).mean() - quality.PRICE * (step[~bad] < e).mean()
    assert gain(least) == max(map(gain, range(-1, 42)))


def test_every_labelled_row_counts(spark, monkeypatch):
    """More labelled rows than trees are grown on: all of them are in the counts of the threshold."""
    seen = []
    real = quality.lengths_counted
    monkeypatch.setattr(quality, "lengths_counted", lambda rows, forests: seen.append(real(rows, forests)) or seen[-1])
    monkeypatch.setattr(quality, "SAMPLE", 1)
    text = " ".join(f"w{k}" for k in range(60))
    frame = spark.range(7000).selectExpr("id as doc_id", f"concat('{text} ', id, if(id % 7 = 0, ' ####', '')) as text")
    quality.fit(frame, frame.selectExpr("doc_id", "cast(doc_id % 7 <> 0 as int) as quality"))
    assert all(c[:, 1].sum() == 1000 and c[:, 2].sum() == 6000 for forests in seen for c in forests)


def test_texts_are_not_shuffled(spark, monkeypatch, capsys):
    """However many labels there are, what is dealt anew to meet them has no text; ids may be of another type than the documents'."""
    seen = []
    real = quality.staged
    monkeypatch.setattr(quality, "staged", lambda df, label: seen.append(df) or real(df, label))
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        capsys.readouterr()
        quality.fit(d, labels)
        seen[0].explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in capsys.readouterr().out.split("\n\n") if re.match(r"\(\d+\) Exchange\n", x.strip())]
    assert dealt and not any("text#" in x for x in dealt)
    want = sorted(tuple(r) for r in quality.measured(d.join(labels.where("quality is not null"), "doc_id").select("doc_id", "text", "quality")).drop("quality").collect())
    quality.fit(d, labels.selectExpr("cast(doc_id as string) doc_id", "quality"))
    for frame in seen:
        assert sorted(tuple(r) for r in frame.drop("quality", "bad").collect()) == want


def test_drawn_rows_are_those_of_least_hash(spark):
    """A bound on the hash keeps rows in their tasks and changes none of those drawn, also where all share an id."""
    rows = spark.range(3000).selectExpr("id as doc_id", *[f"id * {k + 1} as {c}" for k, c in enumerate((*quality.COUNTS, *quality.EXTRA))])
    for frame in (rows, rows.selectExpr("7L as doc_id", *rows.columns[1:])):
        order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id"), *quality.COUNTS]
        want = [tuple(r)[1:] for r in frame.orderBy(*order).collect()]
        for most in (1, 100, 2000, 5000):
            assert [tuple(r) for r in quality.drawn(frame, 3000, most)] == want[:most]
