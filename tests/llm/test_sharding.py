import zlib
from collections import defaultdict

from litomics.llm import sharding

from .cases import docs, sample


def test_law_places_and_groups(spark):
    frame = docs(spark, sample("documents"))
    rows = sharding.shard_documents(frame).collect()
    given = frame.collect()
    assert len(rows) == len(given)
    by_shard, loads = defaultdict(list), defaultdict(int)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))
    want = sorted((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in given)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    longest = max(r["size"] for r in rows)
    assert max(loads.values()) - min(loads.values()) <= longest


def loads_and_homes(spark, texts):
    loads, homes = defaultdict(int), defaultdict(set)
    rows = sharding.shard_documents(docs(spark, texts, extra=False)).collect()
    for r in rows:
        loads[r["shard"]] += r["size"]
        homes[r["text_crc32"]].add(r["shard"])
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    mean = sum(loads.values()) / 8
    return [loads[s] / mean for s in range(8)], homes


def test_equal_texts_share_a_shard_unless_they_cannot_fit(spark):
    _, homes = loads_and_homes(spark, [f"text {i % 50} " * 9 for i in range(400)])
    assert len(homes) == 50
    fill = [f"some other text {i}" for i in range(3000)]
    # half of a shard: stays whole, and the shards are even all the same
    shares, homes = loads_and_homes(spark, [*["same " * 20] * 40, *fill])
    assert len(homes[zlib.crc32(b"same " * 20)]) == 1 and max(shares) < 1.02
    # a third of all bytes: cannot fit a shard
    shares, homes = loads_and_homes(spark, [*["same " * 20] * 300, *fill])
    assert len(homes[zlib.crc32(b"same " * 20)]) == 8 and max(shares) < 1.05
    # a third of all rows, empty: few bytes, many places
    shares, homes = loads_and_homes(spark, [*[""] * 1500, *fill])
    assert len(homes[0]) == 1 and max(shares) < 1.02


def test_split_groups_are_as_few_as_will_do():
    even = dict.fromkeys(range(64), 100)
    assert sharding.split_groups(even, [], 8, 64) == []
    assert sharding.split_groups(even | {3: 700}, [(9, 3, 650)], 8, 64) == []
    assert sharding.split_groups(even | {3: 4000}, [(9, 3, 3900), (8, 5, 90)], 8, 64) == [9]
    nine = {i: 900 for i in range(9)}
    assert sharding.split_groups(nine, [(i, i, 900) for i in range(9)], 8, 64) == list(range(9))


def test_stored_map_is_what_rows_follow(spark, tmp_path):
    path = str(tmp_path / "maps")
    frame = docs(spark, sample("documents"))
    for version in (1, 2):
        rows = sharding.shard_documents(frame, map_path=path).collect()
        stored = {r["slot"]: r["shard"] for r in sharding.load_map(spark, path).collect()}
        assert {r["map_version"] for r in rows} == {version}
        assert all(stored[r["virtual_slot"]] == r["shard"] for r in rows)


def test_versions_and_rebalancing(spark, tmp_path):
    rows = sharding.slotted(sharding.sized(docs(spark, sample("documents"))), 64, 4)
    first = sharding.new_map(spark, sharding.slot_bytes(rows), n_slots=64, n_shards=4)
    grown = sharding.rebalance(first, 5)
    a, b = ({r["slot"]: r["shard"] for r in m.collect()} for m in (first, grown))
    moved = [s for s in a if a[s] != b[s]]
    assert moved and all(b[s] == 4 for s in moved)
    drained = {r["slot"]: r["shard"] for r in sharding.rebalance(first, 4, drained=(0,)).collect()}
    assert 0 not in drained.values()
    path = str(tmp_path / "map")
    sharding.save_map(first, path)
    sharding.save_map(grown, path)
    assert {r["slot"]: r["shard"] for r in sharding.load_map(spark, path).collect()} == b
    assert {r["slot"]: r["shard"] for r in sharding.load_map(spark, path, 1).collect()} == a


def test_empty(spark):
    assert sharding.shard_documents(docs(spark, [], extra=False)).collect() == []
