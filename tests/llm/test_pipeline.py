import corpus_pipeline
from litomics.llm import minhash, packing, pii, quality, templates
from litomics.llm.common import table

from .cases import docs, sample

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "personal_data", "best_fit_packing"]
    labels, benchmark = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        if name == "quality_rules":
            assert ids(out) == ids(quality.judge(docs, labels).where("kept"))
        elif name == "near_dedup":
            assert ids(out) == ids(minhash.classes(docs).where("kept"))
        elif name == "decontamination":
            gone = {r["doc_id"] for r in templates.contained_items(docs, benchmark).collect()}
            assert ids(out) == [i for i in ids(docs) if i not in gone]
        else:
            assert ids(out) == ids(docs)
            found = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
            changed = {r["doc_id"]: r["text"] for r in out.collect()}
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all((changed[i] != before[i]) == bool(found[i]) for i in before)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    assert packing.pack(docs).count() == corpus_pipeline.run(spark, SF).count()


def test_awkward_rows_pass_every_stage(spark):
    frame = docs(spark, sample("documents", 80))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns
        rows = out.collect()
        assert len(rows) <= frame.count() and {r["kept"] for r in rows} <= {"k"}
        assert stage(spark, frame.limit(0), SF).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() >= frame.count()


def test_empty_labels_and_benchmark_and_null_ids(spark, tmp_path):
    """Without labels the rules decide, without a benchmark nothing leaks, and rows without an id go through like others."""
    texts = [t for t in sample("documents", 60) if t]
    frame = spark.createDataFrame([(None if i % 7 == 0 else i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == frame.columns and 0 < out.count() <= kept.count()
        kept = out
    assert {r["doc_id"] is None for r in kept.collect()} == {True, False}
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() >= kept.count()
