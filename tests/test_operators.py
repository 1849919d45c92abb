import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from litomics.functions import classify, genomics, text
from litomics.operators import axis, disease, entities, fdr, filters, links, matrices, scoring, seeds, stats, topology, upsert
from litomics.sources import sinks


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(expression.alias("x")).first()["x"]


def test_distinct_citations(spark):
    papers = spark.createDataFrame([(1, True), (2, False), (3, True)], "paper_id int, included boolean")
    mentions = spark.createDataFrame([(1, "TP53", 3, 7157), (1, "TP53", 1, 7157), (2, "TP53", 5, None), (3, "TP53", 10, 7157), (4, "TP53", 99, 7157), (2, "EGFR", 1, 1956)], "paper_id int, symbol string, mention_count int, entrez int")
    rows = {r["symbol"]: r for r in entities.entity_list(mentions, papers, "symbol", {"entrez_id": F.col("entrez")}).collect()}
    assert tuple(rows["TP53"])[1:] == (3, 2, 19, 7157)
    assert [r["symbol"] for r in entities.entity_list(mentions, papers, "symbol", included_only=True).collect()] == ["TP53"]
    assert [r["symbol"] for r in entities.entity_list(mentions, papers, "symbol", q="gf").collect()] == ["EGFR"]


def test_sentences(spark):
    got = one(spark, text.sentences(F.col("t")), t="See Fig. 2 for p < 0.05, e.g. in the U.S.A. study. Smith et al. found rs12; it held! Was 5.2.1 used? yes")
    assert got == ["See Fig. 2 for p < 0.05, e.g. in the U.S.A. study.", "Smith et al. found rs12;", "it held!", "Was 5.2.1 used?", "yes"]
    assert one(spark, text.sentences(F.col("t")), t=None) == [] and one(spark, text.sentences(F.col("t")), t="  ") == []


def test_contexts_mark_pairs_without_sentence(spark):
    papers = spark.createDataFrame([(1, "We saw TNF here. TNFRSF1A is not it. tnf again!")], "paper_id int, text string")
    pairs = spark.createDataFrame([(1, "TNF"), (1, "IL-6"), (1, "a.b(")], "paper_id int, symbol string")
    rows = sorted((r["symbol"], r["position"]) for r in entities.contexts(papers, pairs, "symbol").collect())
    assert rows == [("IL-6", -1), ("TNF", 0), ("TNF", 2), ("a.b(", -1)]


def test_gene_recognition(spark):
    names = spark.createDataFrame([(x,) for x in ("TP53", "EGFR", "EGFR-AS1", "BCL2", "CDKN2A", "AR", "MYC", "NOT")], "symbol string")

    def found(t):
        papers = spark.createDataFrame([(1, t)], "paper_id int, text string")
        return {r["symbol"]: r["mention_count"] for r in entities.recognise_genes(papers, names, ["NOT"]).collect()}

    assert found("TP53-mutant and EGFR-positive cells express EGFR-AS1 and BCL-2, tp53") == {"TP53": 2, "EGFR": 1, "EGFR-AS1": 1, "BCL2": 1}
    assert found("TP53-CDKN2A alone") == {}
    assert found("MYC and AR without context, not") == {}
    assert found("the gene MYC and ar and AR, not") == {"MYC": 1, "AR": 1}


def test_phrases_longest_first(spark):
    papers = spark.createDataFrame([(1, "Aspirin plus folic acid, then folic ACID and acid.")], "paper_id int, text string")
    names = spark.createDataFrame([("folic acid",), ("acid",), ("aspirin",), ("folic",)], "name string")
    assert {r["name"]: r["mention_count"] for r in entities.recognise_phrases(papers, names).collect()} == {"folic acid": 2, "acid": 1, "aspirin": 1}


def test_phrases_of_many_words(spark):
    papers = spark.createDataFrame([(1, "Given one two three four five six SEVEN daily, and three four.")], "paper_id int, text string")
    names = spark.createDataFrame([("one two three four five six seven",), ("three four",), (None,)], "name string")
    assert {r["name"]: r["mention_count"] for r in entities.recognise_phrases(papers, names).collect()} == {"one two three four five six seven": 1, "three four": 1}
    assert entities.recognise_phrases(papers, names.limit(0)).collect() == []


def test_benjamini_hochberg(spark):
    p = {1: [(0.01, 1), (0.04, 1), (1.0, 0)], 2: [(0.02, 1), (0.02, 1), (0.06, 1)], 3: [(0.10, 1), (0.30, 1), (1.0, 0)], 5: [(1.0, 0)] * 3}
    rows = [(k, s, 10 * k + s, v, float(sd), 0.0) for k, vs in p.items() for s, (v, sd) in enumerate(vs)]
    scores = spark.createDataFrame(rows, "pathway_id int, sample_id int, id int, p_empirical double, null_sd double, z_score double")
    out = {r["id"]: r for r in fdr.adjust(scores, "population").collect()}
    want = {10: 0.02, 11: 0.04, 12: None, 20: 0.03, 21: 0.03, 22: 0.06, 30: 0.20, 31: 0.30, 32: None, 50: None, 51: None, 52: None}
    for i, q in want.items():
        got = out[i]["q_value_across_samples"]
        assert (got is None) == (q is None) and (q is None or abs(got - q) < 1e-12)
        assert (out[i]["fdr_n_tests_across_samples"] == 0) == (q is None)
    full = fdr.adjust(fdr.adjust(scores, "population"), "individual")
    kinds = {r["class"]: r["n_pathways"] for r in fdr.taxonomy(spark.createDataFrame([(i,) for i in range(1, 6)], "pathway_id int"), full, 0.05).collect()}
    assert kinds == {"attributable": 2, "not_attributable": 1, "no_readout": 1, "no_seed": 1}


def test_connectivity(spark):
    nodes = spark.createDataFrame([(1, 1, "gene", "tp53"), (1, 2, "gene", "EGFR"), (1, 3, "gene", "MYC"), (1, 4, "gene", ""), (2, 5, "gene", "TP53")], "pathway_id int, node_id int, node_type string, gene_symbol string")
    edges = spark.createDataFrame([(1, 2, 1, 0), (1, 3, 1, 1), (1, 3, 2, 0)], "pathway_id int, source int, target int, sign int")
    s = spark.createDataFrame([("TP53", "activator"), ("TP53", "inactivator"), ("Egfr", "activator"), ("MYC", "inactivator"), ("MYC", "neutral")], "gene_symbol string, direction string")
    c = topology.connectivity(nodes, edges, s)
    assert {(r["node_id"], r["category"], r["n_seeds"]) for r in c.collect()} == {(1, "no_out", 2), (2, "blind", 1), (3, "useful", 1), (5, "no_out", 2)}
    assert topology.verdict(c).first()["warn"]


def test_variant_keys_and_effects(spark):
    key = genomics.variant_key(*map(F.col, "cpra"))
    cases = {("chr7", "117548628", "G", "A"): "7:117548628:G:A", ("1", "100", "AGCT", "A"): "1:101:GCT:", ("1", "100", "A", "AGT"): "1:101::GT", ("1", "100", "A", "A,T"): None, ("1", "100", "A", "*"): None, ("chrX", "5", "AG", "AT"): "X:6:G:T", ("2", "x", "AG", "A"): None}
    for (c, p, r, a), want in cases.items():
        assert one(spark, key, c=c, p=p, r=r, a=a) == want
    m = lambda o, s, **k: one(spark, genomics.clinvar_magnitude(F.col("o"), F.col("s"), **k), o=o, s=s)
    assert m("", "Pathogenic") == 1.0 and m("", "likely pathogenic") == 0.9 and m("Likely oncogenic", "Benign") == 0.9
    assert m("", "Uncertain significance") is None and m("strange", "Pathogenic") is None and m(None, None) is None
    assert m("", "Likely_pathogenic") == 1.0 and m("", "Likely_pathogenic", underscores=True) == 0.9


def test_allele_table(spark):
    copy = spark.createDataFrame([("s1", "A", "inactivator", 0.4, 0.6), ("s2", "A", "inactivator", 0.4, 0.6), ("s1", "B", "activator", 0.5, 0.6), ("s2", "B", "activator", 0.5, 0.6)], "sample string, gene string, direction string, magnitude double, confidence double")
    snv = spark.createDataFrame([("s1", "a", "inactivator", 0.9), ("s1", "b", "neutral", 0.95)], "sample string, gene string, direction string, magnitude double")
    got = {(r["sample"], r["gene"]): (r["direction"], r["magnitude"], r["confidence"]) for r in seeds.allele_seeds(copy, snv).collect()}
    assert got == {("s1", "A"): ("inactivator", 0.9, 0.95), ("s2", "A"): ("inactivator", 0.4, 0.60), ("s1", "B"): ("neutral", 0.5, 0.40), ("s2", "B"): ("activator", 0.5, 0.70)}


def test_precedence_masks(spark):
    rows = [("s", "A", "neutral", 0.5, 0.4, "", "cnv-v2"), ("s", "a", "inactivator", 0.9, 0.9, "v", "snv-v1"), ("s", "B", "activator", 0.5, 0.6, "", "cnv-v1"), ("s", "B", "inactivator", 0.9, 0.9, "w", "snv-v1")]
    s = spark.createDataFrame(rows, "sample string, gene string, direction string, magnitude double, confidence double, variant_key string, method_version string")
    got = {r["gene"]: (r["method_version"], round(r["weight"], 3), r["masked"]) for r in seeds.effective(s).collect()}
    assert got == {"A": ("cnv-v2", 0.0, True), "B": ("snv-v1", -0.81, False)}


def test_pairing(spark):
    s = spark.createDataFrame([("C1", "tumor", "a"), ("C1", "normal", "b"), ("C2", "tumor", "c"), ("C3", "normal", "d"), ("C4", "tumor", "e"), ("C4", "tumor", "f"), ("C4", "normal", "g")], "case string, role string, sample string")
    assert [tuple(r) for r in matrices.pairs(s, "case", "role", "sample").collect()] == [("C1", "a", "b")]
    assert {r["kind"]: r["n_cases"] for r in matrices.unpaired(s, "case", "role").collect()} == {"paired": 1, "tumor_only": 1, "normal_only": 1, "several": 1}


def test_ulm(spark):
    def t(pairs, least=3):
        rows = spark.createDataFrame([(1, float(x), float(y)) for x, y in pairs], "k int, x double, y double")
        return matrices.ulm(rows, ["k"], "x", "y", least).first()["t"]

    assert abs(t([(1, 3), (-1, 1), (1, 5), (-1, -1)]) - 2 * math.sqrt(2)) < 1e-9
    assert t([(1, 3), (1, 1), (1, 5)]) is None and t([(1, 1), (-1, -1), (1, 1), (-1, -1)]) is None and t([(1, 1), (-1, 2)]) is None


def test_walk_signs_and_linearity():
    for sign in (-1, 1):
        p = scoring.influence(scoring.dense(2, np.array([0]), np.array([1]), np.array([float(sign)])), np.array([[1.0, 0.0]]))[0]
        assert p[0] > 0 and np.sign(p[1]) == sign
    rng = np.random.default_rng(0)
    w = rng.normal(size=(6, 6))
    w /= np.abs(w).sum(axis=1, keepdims=True)
    units = scoring.influence(w, np.eye(6))
    seed = rng.normal(size=6)
    assert np.allclose(seed @ units, scoring.influence(w, seed[None])[0], atol=1e-6)


def test_draws_match_a_plain_generator():
    mask = 2**64 - 1

    def mixed(x):
        z = (x + 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        return z ^ (z >> 31)

    got = scoring.draws(42, 7, 11, 3, 4)
    for b in range(3):
        state = mixed(mixed(mixed(42 ^ 7) ^ 11) ^ b)
        for k in range(4):
            state ^= state >> 12
            state = (state ^ (state << 25)) & mask
            state ^= state >> 27
            assert int(got[b, k]) == (state * 0x2545F4914F6CDD1D) & mask


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    nodes = spark.createDataFrame([(1, i, f"G{i}") for i in range(6)] + [(2, i, f"G{i}") for i in range(3)], "pathway_id long, node_id long, gene string")
    edges = spark.createDataFrame([(1, i, (i + 1) % 6, 1 if i % 2 else -1) for i in range(5)] + [(2, 0, 1, 0)], "pathway_id long, source long, target long, sign int")
    s = spark.createDataFrame([(k, f"G{(k + j) % 6}", 0.5 - j) for k in range(8) for j in range(2)], "sample_id long, gene string, weight double")
    readouts = spark.createDataFrame([(1, i, k, float(i + k)) for i in range(6) for k in range(8)], "pathway_id long, node_id long, sample_id long, value double")
    samples = spark.createDataFrame([(k,) for k in range(9)], "sample_id long")
    a = sorted(map(tuple, scoring.score(nodes, edges, s, readouts, samples, 50).collect()))
    b = sorted(map(tuple, scoring.score(nodes.repartition(7), edges.repartition(5), s.repartition(3), readouts.repartition(6), samples.repartition(4), 50).collect()))
    assert len(a) == 9 and {r[0] for r in a} == {1}
    assert a == b
    monkeypatch.setattr(scoring, "BLOCK_SAMPLES", 2)
    assert a == sorted(map(tuple, scoring.score(nodes, edges, s, readouts, samples, 50).collect()))
    degenerate = next(r for r in a if r[1] == 8)
    assert degenerate[2:8] == (0.0, 0.0, 0.0, 0.0, 1.0, 0)


def test_merges(spark):
    stored = spark.createDataFrame([(1, "long title", "rna", "geo"), (2, "b", "dna", "sra")], "k int, title string, types string, source string")
    new = spark.createDataFrame([(1, "short", "wgs,rna", "unknown"), (3, "c", "", "")], "k int, title string, types string, source string")
    got = {r["k"]: tuple(r)[1:] for r in upsert.upsert(stored, new, ["k"], {"title": "longer", "types": "united", "source": "known"}).collect()}
    assert got == {1: ("long title", "rna,wgs", "geo"), 2: ("b", "dna", "sra"), 3: ("c", "", "")}
    rows = spark.createDataFrame([(1, "aa", 1), (1, "bb", 2), (1, "c", 3)], "pmid int, abstract string, seq int")
    assert upsert.longest_wins(rows, ["pmid"], "abstract", "seq").first()["abstract"] == "aa"
    batch = spark.createDataFrame([("A", 1, "t", "s1", "rna, dna", ["x"], {"a": "1"}, 3, "unknown"), ("A", 2, "tt", "s", "dna", ["y", "x"], {"a": "2", "b": "3"}, 5, "human")], "accession string, seq int, title string, summary string, omic_type string, omics_layers array<string>, metadata map<string,string>, omics_count int, organism string")
    r = upsert.batch_merge(batch).first()
    assert (r["title"], r["summary"], r["omic_type"], r["omics_layers"], r["metadata"], r["omics_count"], r["organism"]) == ("tt", "s1", "dna,rna", ["x", "y"], {"a": "2", "b": "3"}, 5, "human")


def test_links(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (3, 12)], "paper_id int, dataset_id int")
    p, d = spark.createDataFrame([(1,)], "paper_id int"), spark.createDataFrame([(10,)], "dataset_id int")
    assert sorted(map(tuple, links.orphans(pairs, p, d).collect())) == [("dataset", 1, 11), ("paper", 2, 10)]
    project = F.lit(7).alias("project_id")
    assert [tuple(r) for r in links.materialise(pairs, p.select(project, "paper_id"), d.select(project, "dataset_id")).collect()] == [(7, 1, 10)]


def test_top_then_drop_blanks(spark):
    rows = spark.createDataFrame([(1, "")] * 5 + [(1, "a")] * 3 + [(1, "b")] * 2 + [(1, None)], "g int, j string")
    assert [(r["j"], r["n"]) for r in stats.top_groups(rows, "g", "j", 2).collect()] == [("a", 3)]


def test_filters(spark):
    rows = spark.createDataFrame([(1, "Homo sapiens", '{"axis": 0.4}', ["x"]), (2, "50%_mix", '{"axis": {"score": 0.9}}', []), (3, "Mus", "{}", ["y"])], "id int, organism string, conf string, layers array<string>")
    ids = lambda **k: sorted(r["id"] for r in filters.apply(rows, k.pop("params"), **k).collect())
    assert ids(params={"organism": "sapIENS"}, contains=("organism",)) == [1]
    assert ids(params={"organism": "%_m"}, contains=("organism",)) == [2]
    assert ids(params={"s": 0.5}, scores={"s": ("conf", "axis")}) == [2]
    assert ids(params={"layer": "y"}, has={"layer": "layers"}) == [3]
    assert ids(params={"min": "abc"}, at_least={"min": "id"}) == [1, 2, 3]
    with pytest.raises(ValueError):
        filters.bulk_update(rows, "id", "included", None)


def test_classifiers(spark):
    assert one(spark, classify.omic_types(F.col("t")), t="ChIP-seq and RNA-Seq of gut flora") == ["epigenomic", "microbiome", "transcriptomic"]
    assert one(spark, classify.omic_types(F.col("t")), t=None) == ["other"]
    assert tuple(one(spark, classify.control_group(F.col("t")), t="healthy controls vs control; quality control")) == ("unknown", 0.25)
    assert tuple(one(spark, classify.control_group(F.col("t")), t="healthy control, control group")) == ("yes", 0.6667)
    assert tuple(one(spark, classify.single_cell(F.col("t")), t="single-cell scRNA-seq")) == ("single_cell", 0.92)


def test_disease_names(spark):
    terms = spark.createDataFrame([("Cystic  fibrosis!",), ("cystic fibrosys",), ("unrelated thing",)], "term string")
    names = spark.createDataFrame([("monogenic", "cystic fibrosis"), ("complex", "pulmonary fibrosis"), ("complex", "type 2 diabetes")], "axis string, name string")
    assert [(r["axis"], r["name"]) for r in disease.exact_hits(terms, names).collect()] == [("monogenic", "cystic fibrosis")]
    fuzzy = {(r["term"], r["axis"]): round(r["ratio"], 3) for r in disease.fuzzy_hits(terms, names).collect()}
    assert fuzzy == {("Cystic  fibrosis!", "monogenic"): 1.0, ("cystic fibrosys", "monogenic"): 0.933}
    hits = spark.createDataFrame([(1, "monogenic", "cystic fibrosis", 1.0), (1, "complex", "fibrosis", 1.0), (2, "complex", "diabetes", 0.9), (2, "monogenic", "rett", 0.95)], "id int, axis string, name string, ratio double")
    kept = disease.longest_only(hits)
    assert {r["id"]: r["axis"] for r in disease.axis(kept).collect()} == {1: "monogenic", 2: "mixed"}


def test_bulk_update_by_ids(spark):
    rows = spark.createDataFrame([(i, "new", None) for i in range(4)], "id int, curation_status string, curation_reason string")
    want = [(0, "new", None), (1, "out", "why"), (2, "new", None), (3, "out", "why")]
    ids = spark.createDataFrame([(1,), (3,), (3,), (9,)], "id int")
    for given in ([1, 3, 9], ids):
        assert sorted(map(tuple, filters.bulk_update(rows, "id", "out", "why", ids=given).collect())) == want


def test_single_cells_and_controls(spark):
    texts = {
        "SingleCell Proteomics of liver": ("single_cell", 0.9), "scRNA-seq and single cell atlas": ("single_cell", 0.92), "bulk RNA-seq": ("bulk", 0.75), "microarray, bulk sequencing": ("bulk", 0.8),
        "single-cells": ("unknown", 0.0), "10x chromium vs bulk RNA-seq": ("single_cell", 0.9), "SCP in proteomics": ("single_cell", 0.9), "SCP alone": ("unknown", 0.0), "spatial single-cell maps": ("single_cell", 0.9),
    }
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", classify.single_cell(F.col("t")).alias("r"))
    assert {r["t"]: (r["r"]["value"], r["r"]["score"]) for r in frame.collect()} == texts


def test_plain_text_artefacts(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.write_occurrences(spark.createDataFrame([("S1", "1:2:A:T", "TP53", "Missense")], "sample_accession string, variant_key string, gene_symbol string, variant_classification string").coalesce(1), a)
    assert [r["value"] for r in spark.read.text(a).collect()] == ["sample_accession\tvariant_key\tgene_symbol\tvariant_classification", "S1\t1:2:A:T\tTP53\tMissense"]
    sinks.write_regulons(spark.createDataFrame([("MYC", "TP53", 1, 'a"b\nc', 3)], "tf string, target string, mode int, sources string, n_references int").coalesce(1), b)
    assert [r["value"] for r in spark.read.text(b).collect()] == ['{"tf":"MYC","target":"TP53","mode":1,"sources":"a\\"bc","n_references":3}']


def test_words_of_grams_are_worked_out_once(spark):
    """Inside lambdas a column is worked out at each call, so the words must be a variable of their own."""
    for grams in (text.ngrams(F.col("t"), blocked=("study",)), axis.grams(F.col("t"))):
        assert str(grams).count("regexp_extract_all") == 1
    frame = spark.createDataFrame([("Study of the ABLATION study, re-run!",), ("",), (None,)], "t string").select(F.array_sort(text.ngrams(F.col("t"), 2, ("study",))).alias("g"))
    want = ["ablation", "ablation study", "of the", "re-run", "study of", "study re-run", "the ablation"]
    assert [r["g"] for r in frame.collect()] == [want, [], []]


def test_recognition_groups_only_words_that_can_count(spark, monkeypatch):
    """Texts of many words, of which few are symbols or begin a name: the rest is left out before it is grouped."""
    kept = {}
    real = entities.written
    monkeypatch.setattr(entities, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    papers = spark.createDataFrame([(i, " ".join(f"word{i * 100 + k}" for k in range(300)) + " TP53 brca1-x type 2 diabetes, type 2") for i in range(20)], "paper_id long, text string")
    genes = entities.recognise_genes(papers, spark.createDataFrame([("TP53",), ("BRCA1",), ("NONE1",)], "symbol string"))
    assert sorted((r["symbol"], r["mention_count"]) for r in genes.collect()) == [("BRCA1", 1)] * 20 + [("TP53", 1)] * 20
    assert kept["words"].count() == 40
    phrases = entities.recognise_phrases(papers, spark.createDataFrame([("type 2",), ("Type 2 diabetes",), (None,)], "name string"))
    assert sorted((r["name"], r["mention_count"]) for r in phrases.collect()) == [("type 2", 1)] * 20 + [("type 2 diabetes", 1)] * 20
    monkeypatch.undo()
    none = spark.createDataFrame([], "name string")
    assert entities.recognise_phrases(papers, none).count() == 0
