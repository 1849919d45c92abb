"""One megabyte of each kind of text that a pattern or an encoder may take long over, through every operator, in time that grows with its length."""

import time

import pytest

from litomics.llm import minhash, packing, pii, quality, secrets, sharding, substrings, templates, toxicity

MB = 1_000_000
UNITS = ["1", "1+", "ab/", " ", "\n", "@", "a ", "1a", "x", "* ", "*", "1.", "token ", "a@b.", "0123456789abcdef ", "é", "[at]", "A1b2C3", "0", " at b dot ", "i - "]
SECONDS = 240

LABELS = "/root/testdata/sf0.001/labels.parquet"
OPERATORS = {
    "substrings": lambda d, s: substrings.remove_repeats(d),
    "quality": lambda d, s: quality.judge(d, s.read.parquet(LABELS)),
    "templates": lambda d, s: templates.contained_items(d, s.read.parquet("/root/testdata/sf0.001/benchmark.parquet")),
    "toxicity": lambda d, s: toxicity.score_documents(d, s.read.parquet(LABELS)),
    "pii": lambda d, s: pii.find_pii(d),
    "redact": lambda d, s: pii.redact(d),
    "sharding": lambda d, s: sharding.shard_documents(d),
    "packing": lambda d, s: packing.pack(d),
    "minhash": lambda d, s: minhash.classes(d, words=2),
    "secrets": lambda d, s: secrets.find_secrets(d),
}


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    few = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    rows = [(i, (u * (MB // len(u) + 1))[:MB]) for i, u in enumerate(UNITS)] + [(99, "x " + "0" * MB + ".1.1.1 y")] + [(100 + i, t) for i, t in enumerate(few)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_in_time(spark, long_texts, name):
    began = time.perf_counter()
    ids = {r["doc_id"] for r in OPERATORS[name](long_texts, spark).collect()}
    took = time.perf_counter() - began
    print(f"{name}: {took:.1f} s")
    assert ids >= set(range(len(UNITS))) or name == "templates"
    assert took < SECONDS
