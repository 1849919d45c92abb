import random
from pathlib import Path

import pytest

from litomics.operators import stored
from litomics.streaming import mentions

RULES = {"title": "longer", "n": "new"}
SCHEMA = "k long, title string, n long"


def files(path):
    return {str(f.relative_to(path)): (f.stat().st_mtime_ns, f.stat().st_size) for f in Path(path).rglob("*.parquet")}


def rows(frame):
    return sorted(map(tuple, frame.select("k", "title", "n").collect()))


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(k, "a" * (k % 4), k) for k in range(500)], SCHEMA)
    assert len(stored.merge_batch(first, path, ["k"], RULES, 0, 16)) == 16
    before = files(path)
    written = stored.merge_batch(spark.createDataFrame([(7, "long title", -1)], SCHEMA), path, ["k"], RULES, 1, 16)
    after = files(path)
    assert len(written) == 1 and all(after[f] == s for f, s in before.items())
    new = [f for f in after if f not in before]
    assert len(new) == 1 and new[0].startswith(f"bucket={written[0]}/version=1/")
    assert rows(stored.current(spark, path)) == sorted((k, "long title" if k == 7 else "a" * (k % 4), -1 if k == 7 else k) for k in range(500))
    # the same batch again, and an older one
    for number in (1, 0):
        assert stored.merge_batch(spark.createDataFrame([(7, "another title, longer still", 9)], SCHEMA), path, ["k"], RULES, number, 16) == []
    assert files(path) == after
    assert stored.vacuum(spark, path, keep=1) == 1
    assert rows(stored.current(spark, path))[7] == (7, "long title", -1)


def test_a_batch_that_broke_off_is_finished(spark, tmp_path):
    """Some buckets of a batch are written, others are not; running it again writes the others only."""
    path = str(tmp_path / "t")
    stored.merge_batch(spark.createDataFrame([(k, "t", 0) for k in range(100)], SCHEMA), path, ["k"], RULES, 0, 8)
    batch = spark.createDataFrame([(k, "tt", k) for k in range(100)], SCHEMA)
    assert len(stored.merge_batch(batch, path, ["k"], RULES, 1, 8)) == 8
    for b in (2, 5):
        for f in Path(path, f"bucket={b}", "version=1").iterdir():
            f.unlink()
        Path(path, f"bucket={b}", "version=1").rmdir()
    kept = files(path)
    assert stored.merge_batch(batch, path, ["k"], RULES, 1, 8) == [2, 5]
    assert all(files(path)[f] == s for f, s in kept.items())
    assert rows(stored.current(spark, path)) == [(k, "tt", k) for k in range(100)]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_against_a_dictionary(spark, tmp_path, seed):
    rng, path, want = random.Random(seed), str(tmp_path / "t"), {}
    for number in range(4):
        batch = {rng.randrange(60): ("x" * rng.randrange(6), rng.randrange(100)) for _ in range(rng.randrange(1, 40))}
        stored.merge_batch(spark.createDataFrame([(k, *v) for k, v in batch.items()], SCHEMA), path, ["k"], RULES, number, 4)
        for k, (title, n) in batch.items():
            old = want.get(k)
            want[k] = (title if old is None or len(title) > len(old[0]) else old[0], n)
        assert rows(stored.current(spark, path)) == sorted((k, *v) for k, v in want.items())


def test_stream_merges_files(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / x) for x in ("landing", "table", "checkpoint"))
    put = lambda rows: spark.createDataFrame(rows, "paper_id long, symbol string, mention_count long").selectExpr("*", "timestamp'2024-01-01' ts").coalesce(1).write.mode("append").parquet(landing)
    put([(1, "A", 2), (1, "A", 3), (2, "B", 1)])
    mentions.merge_buckets(spark, landing, table, checkpoint, 4).awaitTermination()
    put([(1, "A", 7), (3, "C", 1)])
    mentions.merge_buckets(spark, landing, table, checkpoint, 4).awaitTermination()
    got = sorted((r["paper_id"], r["symbol"], r["mention_count"]) for r in stored.current(spark, table).collect())
    assert got == [(1, "A", 7), (2, "B", 1), (3, "C", 1)]
