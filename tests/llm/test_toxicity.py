import math
import zlib

from litomics.llm import toxicity

from .cases import docs, sample


def model(spark):
    text = " ".join(["you are an idiot and a moron", "what a stupid loser", "the weather is fine today"] * 50)
    return toxicity.CharModel(toxicity.trigram_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")))


def test_decoding(spark):
    m = model(spark)
    for seen, word in [("1d10t", "idiot"), ("m0r0n", "moron"), ("idiooot", "idiot"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("$tup1d", "stupid"), ("i   d   i   o   t", "idiot"), ("i - d - i - o - t", "idiot"), ("i... d... i... o... t", "idiot"),
                       ("i\td\ti\to\tt", "idiot"), ("i\nd\n\ni\no\nt", "idiot"), ("1 , d , 1 , 0 , t", "idiot"), ("iiddiioott", "idiot"), ("m/o/r/o/n", "moron")]:
        words = toxicity.restored_words(f"so you {seen}, really".encode(), m, {})
        assert word.encode() in words, (seen, words)
    assert toxicity.restored_words(b"Plain words, only!", m, {}) == {b"plain", b"words", b"only"}


def test_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(d.join(labels.select("doc_id"), "doc_id"), labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    toxic, clean = [r for r in held if r["toxic"] == 1], [r for r in held if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)


def test_awkward(spark):
    frame = docs(spark, sample("documents", 60))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = toxicity.score_documents(frame, labels).collect()
    assert len(rows) == frame.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxicity.score_documents(frame.limit(0), labels).collect() == []
    assert {r["predicted"] for r in toxicity.score_documents(frame, labels.limit(0)).collect()} == {0}


def test_signs_at_edges_and_long_words(spark):
    text = " ".join(["you are an idiot and a moron", "what a stupid loser", "such an asshole or ass", "an insane clown", "the nazi party", "the weather is fine today"] * 50)
    m = toxicity.CharModel(toxicity.trigram_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    long = "idi" + "o" * 40 + "t"
    for seen, word in [("$tupid", "stupid"), ("@sshole", "asshole"), ("a$$", "ass"), ("(lown", "clown"), ("naz!", "nazi"), (long, "idiot"), ("1d1" + "0" * 60 + "t", "idiot"), ("1d10t!", "idiot")]:
        for around in ("so you {} really", "{}", "so you {}."):
            words = toxicity.restored_words(around.format(seen).encode(), m, {})
            assert word.encode() in words, (seen, around, words)
    assert len(m.decode("ab1" * 20_000)) >= 40_000


def all_readings(seen, model):
    """Every path of a word's lattice with its score, one by one."""
    paths = [("", 0.0, (0, 0))]
    last, closing = "", len(seen.rstrip("!"))
    for i, c in enumerate(seen):
        if c.isalpha():
            options = [(c, 0.0)] + ([("", -0.7)] if c == last else [])
        else:
            options = [(x, -1.5) for x in toxicity.LEET.get(c, "")]
            options += [("", -0.7)] if c in toxicity.SEPARATORS or c == last or i >= closing else []
            options += [(c, -3.0)] if not options or c.isdigit() else []
        last = c
        grown = []
        for word, score, (a, b) in paths:
            for letter, cost in options:
                if letter:
                    k = model.code(letter)
                    grown.append((word + letter, score + cost + model.log[a][b][k], (b, k)))
                elif word:
                    grown.append((word, score + cost, (a, b)))
        paths = grown or paths
    return {w: max(s + model.log[a][b][0] for w2, s, (a, b) in paths if w2 == w) for w, _, _ in paths}


def test_viterbi_against_all_paths(spark):
    m = model(spark)
    for seen in ("1d10t", "m0r0n", "l.o.s.e.r", "idiooot", "$tup1d!", "a*s#", "5tup!!d", "1111", "b00"):
        every = all_readings(seen, m)
        assert abs(every[m.decode(seen)] - max(every.values())) < 1e-9, seen


def test_scores_against_a_plain_version(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.fit(d, labels)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    y = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] in texts}
    bags = {i: toxicity.restored_words((texts[i] or "").encode(), scorer.model, {}) for i in y}
    n_toxic, n_clean, want = sum(y.values()), len(y) - sum(y.values()), {}
    for w in set().union(*bags.values()):
        n, k = sum(w in b for b in bags.values()), sum(w in b for i, b in bags.items() if y[i])
        if n >= 3 and k:
            v = math.log(((k + 0.1) / (n_toxic + 0.2)) / ((n - k + 0.1) / (n_clean + 0.2))) - 2.5 * math.sqrt(1 / (k + 0.5) + 1 / (n - k + 0.5))
            if v > 0.8:
                want[w] = v
    assert want.keys() == scorer.weights.keys() and all(abs(v - scorer.weights[w]) < 1e-9 for w, v in want.items())
    for i in list(texts)[:60]:
        hits = [want[w] for w in toxicity.restored_words((texts[i] or "").encode(), scorer.model, {}) if w in want]
        z = scorer.coefficients @ [max(hits, default=0), min(sum(hits), 20), 1]
        assert abs(scorer.score((texts[i] or "").encode(), {}) - 1 / (1 + math.exp(-z))) < 1e-9


def test_least_letters(spark):
    m = model(spark)
    for seen in ("1d10t", "l...o.s.e.r", "idiooot", "a*s#", "5tup!!d!!", "1111", "i d i o t", "x-1"):
        words = all_readings(seen.replace(" ", "."), m)
        assert min(map(len, words)) >= toxicity.least_letters(seen) > 0, seen
