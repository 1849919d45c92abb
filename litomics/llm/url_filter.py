"""URL filter by a Bloom filter cascade: exact membership of a key list over the corpus's own keys, without joins.

Level 1 encodes the listed keys, level 2 those keys of the universe that level 1 takes wrongly, level 3 the listed keys
that level 2 takes wrongly, and so on until a level takes none wrongly. The universe is every key that any url of the
corpus yields, so for these urls the answer of the cascade is exact. Level 1's rate follows from an estimate of the
universe's size, so that about as many keys pass wrongly as are listed. Levels are built in tasks, from tables of keys: the driver only sees
their bits, about 2 bytes for a listed key at the estimated rate, which is what is broadcast. No length of list is refused.

Keys of a url: each suffix of its host at a label's boundary, alone (listed domains) and followed by the path's first
characters for each length that a rule's path has (rules).

Nulls: a url that is null or has no `://` has an empty host and path, fits no rule and is allowed. Repeated rows
stay. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from .common import discard, staged, table

#: (verdict, host, path) of the rules; the longest that fits wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Domains blocked where no rule fits.
LISTED = tuple(f"{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))
#: Level 1 is sharpened while it takes more than this many times the listed keys wrongly (and more than a thousand).
SHARPEN = 64


def url_parts(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


def url_keys(host: str, path: str, lengths: Iterable[int], longest: int) -> Iterator[tuple[str, int, str]]:
    """(key, length of the path in it, host suffix); suffixes longer than `longest`, the longest listed key, can't be listed."""
    at = 0
    if len(host) > longest:
        at = host.find(".", len(host) - longest - 1) + 1
        if not at:
            return
    while host:
        suffix = host[at:]
        yield suffix, 0, suffix
        for n in lengths:
            if len(path) >= n:
                yield suffix + path[:n], n, suffix
        dot = host.find(".", at)
        if dot < 0:
            return
        at = dot + 1


class Bloom:
    """A Bloom filter over strings; each level has a seed of its own."""

    def __init__(self, n_keys: int, rate: float, seed: int) -> None:
        self.seed = seed
        self.n_bits = max(64, math.ceil(-n_keys * math.log(rate) / math.log(2) ** 2))
        self.n_hashes = max(1, round(-math.log2(rate)))
        self.bits = np.zeros(-(-self.n_bits // 8), np.uint8)

    def places(self, key: str) -> list[int]:
        h = xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.seed)
        a, b = h >> 64, (h & 0xFFFFFFFFFFFFFFFF) | 1
        return [(a + i * b) % self.n_bits for i in range(self.n_hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[i >> 3] & (128 >> (i & 7)) for i in self.places(key))

    def filled(self, keys: DataFrame) -> Bloom:
        """With all of `keys`; tasks send the bytes of the filter that are not empty."""
        places = self.places

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                at = np.array([i for k in f["key"] for i in places(k)], np.int64)
                yield pd.DataFrame({"byte": at >> 3, "bit": (128 >> (at & 7)).astype(np.int32)})

        rows = keys.mapInPandas(run, "byte long, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()  # n_bits / 8 rows at most
        self.bits[rows["byte"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.uint8)
        return self


def taken(keys: DataFrame, level: Bloom) -> DataFrame:
    """The keys that a level takes."""
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": [k for k in f["key"] if k in sent.value]}, dtype=object)

    return keys.mapInPandas(run, "key string")


class Cascade:
    """Alternate levels; a key is listed if the first level that refuses it has an even number (from 1)."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, n_universe: int) -> Cascade:
        """`listed` and `universe` have a column `key`; `listed` has each key once, `n_universe` is a guess."""
        n_listed = listed.count()
        rate = min(0.5, max(1e-9, math.sqrt(0.5) * n_listed / max(n_universe, 1)))
        while True:
            levels = [Bloom(n_listed, rate, 0).filled(listed)]
            # while building, what is listed is told by a join; afterwards by the cascade alone
            wrong = staged(taken(universe, levels[0]).distinct().join(listed, "key", "left_anti"), "wrong")
            n = wrong.count()
            if n <= max(1000, SHARPEN * n_listed) or rate <= 1e-9:
                break
            discard(wrong)
            rate = max(1e-9, rate / SHARPEN)  # the guess was low: a sharper first level, not fewer keys
        inside, outside = wrong, listed
        while n:
            levels.append(Bloom(n, 0.5, len(levels)).filled(inside))
            inside, outside = staged(taken(outside, levels[-1]), "level"), inside
            n = inside.count()
        return cls(levels)


def filter_urls(pages: DataFrame, rules: tuple = RULES, listed: tuple[str, ...] | DataFrame = LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of `pages`. A long list of domains can be a DataFrame with a column `key`."""
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, _, p in rules})
    verdicts = {h + p: v for v, h, p in rules}
    domains = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(k,) for k in listed], "key string")
    every = spark.createDataFrame([(k,) for k in verdicts], "key string").union(domains.select("key")).where("key is not null")
    keys = staged(every.distinct(), "keys")
    longest = keys.agg(F.max(F.length("key"))).first()[0] or 0

    def all_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": [k for u in f["url"] for k, _, _ in url_keys(*url_parts(u), lengths, longest)]}, dtype=object)

    universe = pages.select("url").mapInPandas(all_keys, "key string")
    n = universe.agg(F.approx_count_distinct("key")).first()[0]
    cascade = spark.sparkContext.broadcast(Cascade.build(keys, universe, n))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = cascade.value
        for batch in batches:
            out: dict[str, list] = {"host": [], "path": [], "rule": [], "verdict": []}
            for u in batch.column("url").to_pylist():
                host, path = url_parts(u)
                rule, verdict = None, "allow"
                for key, n_path, _ in url_keys(host, path, lengths, longest):
                    if key in member:
                        if not n_path:
                            verdict = "block" if rule is None else verdict
                        elif rule is None or len(key) > len(rule):
                            rule, verdict = key, verdicts[key]
                for name, value in zip(out, (host, path, rule, verdict), strict=True):
                    out[name].append(value)
            columns = [batch.column("page_id"), *(pa.array(v, pa.string()) for v in out.values())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", *out])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url").mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string")


def op10_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
