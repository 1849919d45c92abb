import pyarrow as pa
import pytest

from litomics.functions.stemming import STOP_WORDS, lexemes, stem
from litomics.operators import search

# Published pairs of the English stemmer.
PAIRS = """consigned>consign consignment>consign consistency>consist consolatory>consolatori consolidate>consolid consonant>conson conspicuously>conspicu conspiracy>conspiraci
constancy>constanc kneeling>kneel knightly>knight knitting>knit knives>knive knotty>knotti generate>generat generously>generous communism>communism arsenal>arsenal happy>happi skies>sky flies>fli
ties>tie dies>die gas>gas kiwis>kiwi hopping>hop hoping>hope luxuriating>luxuri relational>relat rational>ration vietnamization>vietnam electricity>electr formative>format adoption>adopt controlling>control
roll>roll mutations>mutat proceeding>proceed succeeds>succeed agreed>agre cries>cri by>by say>say boyish>boyish biology>biolog hopefulness>hope bed>bed fizzed>fizz eye>eye news>news early>earli abyss>abyss"""


@pytest.mark.parametrize("pair", PAIRS.split())
def test_stems(pair):
    word, want = pair.split(">")
    assert stem(word) == want


def test_lexemes():
    assert lexemes("The mutations of BRCA1's follow-up, aren't they?") == ["mutat", "brca1", "follow-up", "follow", "aren"]
    assert lexemes(" ".join(STOP_WORDS)) == [] and lexemes("") == [] and lexemes("-- ' _") == []


DOCS = [
    (1, "Mutations in genes", "A study of mutated cells."),
    (2, "Cells", "The gene is mutating; the mutation was found."),
    (3, "The and of", None),
    (4, None, "Genes mutate and cells divide. Genes mutate."),
    (70_000, "gene mutation", "far away"),
    (-5, "genes", "mutations"),
    (None, "genes", "mutations"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    search.build_index(spark.createDataFrame(DOCS, "id long, title string, abstract string"), "id", ["title", "abstract"], path)
    return path


@pytest.mark.parametrize("query, field, want", [
    ("mutation", None, [-5, 1, 2, 4, 70_000]), ("The mutations of a gene", None, [-5, 1, 2, 4, 70_000]), ("cell mutation gene", None, [1, 2, 4]), ("gene", 0, [-5, 1, 70_000]),
    ("gene", 1, [2, 4]), ("mutation gene", 0, [1, 70_000]), ("the of", None, []), ("", None, []), ("absent", None, []), ("gene absent", None, []), ("far", 0, []),
])
def test_index(spark, index, query, field, want):
    assert sorted(r["id"] for r in search.search(spark, index, query, field).collect()) == want


def test_index_and_scan_agree(spark, index):
    rows = spark.createDataFrame([d for d in DOCS if d[0] is not None], "id long, title string, abstract string")
    for q in ("mutation", "cells gene", "the", "divide"):
        assert sorted(r["id"] for r in search.matching(rows, "id", ["title", "abstract"], q).collect()) == sorted(r["id"] for r in search.search(spark, index, q).collect())


def test_blocks_are_bounded_and_queries_read_no_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_IDS", 64)
    path = str(tmp_path / "i")
    search.build_index(spark.range(1000).selectExpr("id", "if(id % 2 = 0, 'common words', 'words') as text"), "id", ["text"], path)
    rows = spark.read.parquet(path)
    assert rows.selectExpr("max(size(ids))").first()[0] == 64 and "text" not in rows.columns
    assert sorted(r["id"] for r in search.search(spark, path, "common word").collect()) == list(range(0, 1000, 2))
    plan = search.search(spark, path, "common word")._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters" in plan and "In(term" in plan


def test_terms_leave_a_task_in_small_batches():
    rows = pa.RecordBatch.from_pydict({"id": list(range(1001)), "text": [f"mutation{i} gene{i} genes" for i in range(1001)]})
    out = list(search.term_batches(iter([rows, rows.slice(0, 0)]), "id", ["text"]))
    assert max(b.num_rows for b in out) <= 4 * search.ROWS
    assert {r["id"] for b in out for r in b.to_pylist()} == set(range(1001))
