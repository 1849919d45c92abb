"""Fixed virtual slots: records hash into thousands of slots, slots map to shards, the map is versioned.

A record's virtual slot depends on its text alone, so equal texts share a slot and a shard. Bytes are aggregated per slot; a map of slots to
shards balances them (law `bytes`), is stored as a version, and rows are assigned from the stored version. Adding or draining a
shard edits the map: few slots move, all others keep their shard. Only the map, one row for each slot, and the groups over LARGE of a
shard, fewer than N_SHARDS / LARGE, are ever on the driver; neither grows with the rows.

Groups that cannot stay whole: a group of equal texts that leaves no balance, however slots are dealt, is split, its rows dealt over all slots. Which
groups these are follows from trying: none, then those over a shard's mean bytes, then over half of it, and so on,
until the shards differ by at most UNEVEN of their mean, or by the heaviest slot without such groups. So a group keeps one shard wherever the law allows it. A split
group's rows change slots, as these groups may when the corpus grows; all other rows never do.

Nulls: a null text has size 1, crc32 0 and the hash of the empty text; a null doc_id is a key like others. Equal rows are
kept, each with a place of its own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, shared_dir, staged, table

N_SLOTS = 4096
N_SHARDS = 8
#: Part of a shard's mean bytes from which a group of equal texts is looked at by itself.
LARGE = 1 / 64
#: Part of a shard's mean bytes by which shards may differ before a group is split.
UNEVEN = 0.005

MAP_SCHEMA = "version int, slot int, shard int, bytes long, n_rows long"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc, a hash of the text, and a number that tells rows apart; the text itself goes no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )


def dealt(loads: dict[int, int], n_shards: int) -> tuple[dict[int, int], int]:
    """Slots to shards, heaviest first to the lightest shard; and the difference between the heaviest and the lightest shard."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for slot in sorted(loads, key=lambda s: (-loads[s], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + loads[slot], shard))
    return out, max(heap)[0] - min(heap)[0]


def split_groups(by_slot: dict[int, int], large: list[tuple[int, int, int]], n_shards: int, n_slots: int) -> list[int]:
    """The groups of `large` (group, slot, bytes) that no dealing of whole slots can balance; as few and as heavy as will do."""
    mean = sum(by_slot.values()) / n_shards
    most = max(mean, 1.0)
    bare = dict(by_slot)
    for _, slot, b in large:
        bare[slot] -= b
    # no dealing of slots is finer than the slots are
    allowed = max(UNEVEN * mean, *bare.values(), 0)
    gone: list[int] = []
    while True:
        loads = dict.fromkeys(range(n_slots), 0.0) | {k: float(v) for k, v in by_slot.items()}
        shared = sum(b for g, _, b in large if g in gone)
        for g, slot, b in large:
            loads[slot] -= b * (g in gone)
        loads = {k: v + shared / n_slots for k, v in loads.items()}
        if dealt(loads, n_shards)[1] <= allowed or len(gone) == len(large):
            return gone
        gone = [g for g, _, b in large if b > most]
        most /= 2


def slotted(rows: DataFrame, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> DataFrame:
    """Adds virtual_slot. Sums per group come first; only large groups are looked at one by one."""
    home = F.pmod("group", F.lit(n_slots)).cast("int")
    all_bytes = rows.agg(F.sum("size")).first()[0] or 0
    large = (
        rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies"))
        .where((F.col("bytes") > all_bytes * LARGE / n_shards) & (F.col("copies") > 1)).select("group", home.alias("slot"), "bytes")
    )
    found = [tuple(r) for r in large.collect()]  # fewer than n_shards / LARGE
    by_slot = {r[0]: r[1] for r in rows.groupBy(home).agg(F.sum("size")).collect()} if found else {}
    gone = split_groups(by_slot, found, n_shards, n_slots)
    key = F.when(F.col("group").isin(gone), F.xxhash64("group", "row")).otherwise(F.col("group")) if gone else F.col("group")
    return rows.withColumn("virtual_slot", F.pmod(key, F.lit(n_slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def new_map(spark: SparkSession, by_slot: DataFrame, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS, version: int = 1) -> DataFrame:
    """Deals slots to shards. Every slot has an entry, empty ones too."""
    found = {r.virtual_slot: (r.bytes, r.n_rows) for r in by_slot.collect()}  # n_slots rows at most
    shard_of, _ = dealt({s: found.get(s, (0, 0))[0] for s in range(n_slots)}, n_shards)
    return spark.createDataFrame([(version, s, shard_of[s], *found.get(s, (0, 0))) for s in range(n_slots)], MAP_SCHEMA)


def rebalance(slot_map: DataFrame, n_shards: int, drained: tuple[int, ...] = ()) -> DataFrame:
    """The next version: slots move only off drained shards and off shards above the mean, to the lightest shards."""
    entries = [r.asDict() for r in slot_map.collect()]  # one row for each slot
    live = [s for s in range(n_shards) if s not in drained]
    if not live:
        raise ValueError("no shard is left")
    loads = dict.fromkeys(live, 0)
    homeless = []
    for e in entries:
        if e["shard"] in loads:
            loads[e["shard"]] += e["bytes"]
        else:
            homeless.append(e)
    mean = sum(e["bytes"] for e in entries) / len(live)
    for e in sorted(entries, key=lambda e: (-e["bytes"], e["slot"])):
        if e["shard"] in loads and e["bytes"] and loads[e["shard"]] - e["bytes"] >= mean:
            loads[e["shard"]] -= e["bytes"]
            homeless.append(e)
    for e in sorted(homeless, key=lambda e: (-e["bytes"], e["slot"])):
        e["shard"] = min(live, key=lambda s: (loads[s], s))
        loads[e["shard"]] += e["bytes"]
    version = max((e["version"] for e in entries), default=0) + 1
    rows = [(version, e["slot"], e["shard"], e["bytes"], e["n_rows"]) for e in entries]
    return slot_map.sparkSession.createDataFrame(rows, MAP_SCHEMA)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Appends a version; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def newest_version(spark: SparkSession, path: str) -> int:
    """0 where no map is stored yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MAP_SCHEMA).parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the newest by default."""
    every = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = newest_version(spark, path)
    return every.where(F.col("version") == version)


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds map_version, shard and slot, the row's place in its shard from 0 on.

    A place is the rows in the shard's earlier virtual slots, from the map, plus the row's number in its own. A slot with
    many rows is numbered in buckets, so no task sees more than a bucket at a time."""
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select(F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first"), F.col("version").alias("map_version"))
    counts = {r["slot"]: r["n_rows"] for r in slot_map.where("n_rows > 0").collect()}  # one row for each slot
    return numbered(rows, "virtual_slot", counts, "row").join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("first") + F.col("number"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every row of `docs`.

    The map is stored at `map_path`, a folder of the shared one by default, as version 1 or as the one after the newest there."""
    spark = docs.sparkSession
    rows = staged(slotted(staged(sized(docs), "sized"), n_slots, n_shards), "slotted")
    version = 1 + (newest_version(spark, map_path) if map_path else 0)
    path = map_path or f"{shared_dir(spark)}/litomics/{uuid.uuid4().hex}-map"
    save_map(new_map(spark, slot_bytes(rows), n_slots, n_shards, version), path)
    return assign(rows, load_map(spark, path, version)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
