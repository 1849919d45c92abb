"""Product codes of vectors by Yinyang Lloyd: one codebook for each quarter of a vector, trained by rounds that skip what bounds rule out.

The entries of a codebook are clustered into groups. Each part of each vector keeps its entry and, for each group, a lower bound of its distance to the group's other entries. A round
lowers a bound by the furthest that an entry of the group has moved; a group whose bound stays above the exact distance to the part's own entry is not scanned. What is
scanned is first measured in floating point; entries as near as the rounding allow are then compared in integers, and ties go to the lower index. So skipping changes no code.

A round is one pass over a staged table of whole-number vectors, codes and bounds. Each task sends the changes of its sums only: one row for each entry that a vector left or joined.
On the driver are the codebooks (N_ENTRIES entries for each of N_PARTS parts) and one sum for each entry. A round's table is removed when the next one is written.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped, and so are those of which the squared distances may not fit 63 bits (a component over `limit`). All vectors
have one length: the one that most kept rows have (the longer of equally common ones); rows of other lengths are dropped. A length that 4 does not divide is filled up with zeros, which changes
no distance. vec_ids are ascending with nulls last, equal ones in the order of their vectors, so repeated rows are entries of their own. With fewer than 256 rows there are as
many entries as rows. A null label is a label of its own; a label_error that 63 bits cannot hold is null. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, discard, looked_up, staged, table

N_PARTS = 4
N_ENTRIES = 256
N_ROUNDS = 4
N_GROUPS = 16
SCALE = 1024
#: Vectors that one numpy pass takes at once.
BLOCK = 2048

#: values: the components as whole numbers; codes: an entry for each part; bounds: N_GROUPS lower bounds for each part; errors: the squared distance of each part.
STATE = "vec_id long, label long, values array<long>, codes array<int>, bounds array<float>, errors array<long>"


def limit(width: int) -> int:
    """The largest whole component with which the squared distance of all parts fits 63 bits."""
    return math.isqrt((2**63 - 1) // (4 * max(1, width)))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label and values of the rows that take part, and the length of a part."""
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(
        "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    )
    # one row for each length
    common = sound.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = common[0]["length"] if common else 0
    most = limit(length) / SCALE
    kept = sound.where((F.size("embedding") == length) & ~F.exists("embedding", lambda x: F.abs(x) >= F.lit(most)))
    width = -(-length // N_PARTS)
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    if width * N_PARTS > length:
        values = F.concat(values, F.array_repeat(F.lit(0).cast("long"), width * N_PARTS - length))
    return kept.select("vec_id", "label", values.alias("values")), width


def first_codebooks(rows: DataFrame, width: int) -> np.ndarray:
    """(part, entry, component) of the first N_ENTRIES rows."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "values").limit(N_ENTRIES).select("values").collect()
    return np.array([r["values"] for r in first], np.int64).reshape(len(first), N_PARTS, width).transpose(1, 0, 2).copy()


def grouped(entries: np.ndarray, n_groups: int = N_GROUPS) -> np.ndarray:
    """The group of each entry of one codebook: a few rounds of k-means over the entries. Any grouping gives the same codes; near entries together skip more."""
    n = min(n_groups, len(entries))
    x = entries.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(5):
        of = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[of == g].mean(0) if (of == g).any() else centres[g] for g in range(n)])
    return of


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances in floating point, of every row to every entry."""
    a, b = x.astype(np.float64), entries.astype(np.float64)
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances in integers, of each row to the entry beside it."""
    d = x - entries
    return (d * d).sum(1)


def slack(x: np.ndarray, entries: np.ndarray) -> float:
    """More than the rounding of `squared` can be, whatever the order of its sums."""
    largest = float(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    return 4 * (x.shape[1] + 4) * 2.0**-52 * x.shape[1] * 4 * largest * largest


def nearest(x: np.ndarray, entries: np.ndarray, wide: np.ndarray, own: np.ndarray, own_d: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, of its own one and those of `among` (indices of columns of `wide`); ties to the lower index."""
    off = slack(x, entries)
    close = wide <= np.minimum(wide.min(1, initial=np.inf), own_d.astype(np.float64) * (1 + 2.0**-50))[:, None] + 2 * off
    at, col = np.nonzero(close)
    best, best_d = own.copy(), own_d.copy()
    if len(at):
        index = among[col]
        d = exact(x[at], entries[index])
        at, index, d = np.concatenate([at, np.arange(len(x))]), np.concatenate([index, own]), np.concatenate([d, own_d])
        order = np.lexsort((index, d, at))
        first = np.unique(at[order], return_index=True)[1]
        best, best_d = index[order][first], d[order][first]
    return best, best_d


def below(distances: np.ndarray, off: float) -> np.ndarray:
    """Lower bounds of distances as 32-bit floats, from squared ones that rounding may have raised by `off`."""
    low = np.sqrt(np.maximum(distances - off, 0)).astype(np.float32)
    return np.nextafter(low, np.float32(-np.inf))


def assign_part(x: np.ndarray, entries: np.ndarray, groups: np.ndarray, codes: np.ndarray | None, bounds: np.ndarray, moved: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, squared distances, bounds of one part of some vectors, and how many distances were measured.

    `codes` None: nothing is known, everything is scanned. `moved`: how far each entry has moved since the bounds were made, rounded up."""
    n, off = len(x), slack(x, entries)
    if codes is None:
        old, own_d = np.zeros(n, np.int64), exact(x, np.broadcast_to(entries[0], x.shape))
        fails = np.ones((n, N_GROUPS), bool)
    else:
        old, own_d = codes.astype(np.int64), exact(x, entries[codes])
        drift = np.array([moved[groups == g].max(initial=0) for g in range(N_GROUPS)], np.float32)
        bounds = np.nextafter(bounds - np.nextafter(drift, np.float32(np.inf)), np.float32(-np.inf))
        # the rounded-up distance to the own entry: a group stays unscanned only if it surely has no nearer and no equally near entry
        fails = bounds <= np.nextafter(np.sqrt(own_d.astype(np.float64)).astype(np.float32), np.float32(np.inf))[:, None]
    best, best_d, measured = old.copy(), own_d.copy(), n
    seconds = bounds.copy()
    scanned: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(N_GROUPS):
        among, rows = np.flatnonzero(groups == g), np.flatnonzero(fails[:, g])
        if not len(among):
            seconds[:, g] = np.float32(np.inf)
            continue
        if not len(rows):
            continue
        wide = squared(x[rows], entries[among])
        measured += wide.size
        b, d = nearest(x[rows], entries, wide, best[rows], best_d[rows], among)
        best[rows], best_d[rows] = b, d
        scanned.append((g, rows, among, wide))
    for g, rows, among, wide in scanned:
        wide[among[None] == best[rows][:, None]] = np.inf
        seconds[rows, g] = below(wide.min(1), off)
    # an entry that was left is one of its group's others now
    left = np.flatnonzero(best != old)
    if codes is not None and len(left):
        g = groups[old[left]]
        seconds[left, g] = np.minimum(seconds[left, g], below(own_d[left].astype(np.float64), off))
    return best, best_d, seconds, measured


def round_of(width: int, codebooks: np.ndarray, groups: np.ndarray, moved: np.ndarray | None, counters=None):
    """A pass over a staged table: assigns every part anew. `moved` None: the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                x = part.column("values").flatten().to_numpy(zero_copy_only=False).reshape(n, N_PARTS, width)
                if moved is not None:
                    codes = part.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(n, N_PARTS)
                    bounds = part.column("bounds").flatten().to_numpy(zero_copy_only=False).reshape(n, N_PARTS, N_GROUPS)
                else:
                    codes, bounds = None, np.zeros((n, N_PARTS, N_GROUPS), np.float32)
                found = [assign_part(x[:, p], codebooks[p], groups[p], None if codes is None else codes[:, p], bounds[:, p], None if moved is None else moved[p]) for p in range(N_PARTS)]
                if counters is not None:
                    counters.add(sum(f[3] for f in found))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), part.column("values"), lists(np.stack([f[0] for f in found], 1).astype(np.int32)),
                     lists(np.stack([f[2] for f in found], 1).reshape(n, -1)), lists(np.stack([f[1] for f in found], 1)), lists(codes if codes is not None else np.full((n, N_PARTS), -1, np.int32))],
                    ["vec_id", "label", "values", "codes", "bounds", "errors", "before"],
                )

    return run


def lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a).ravel()))


def changes(width: int, n_entries: int):
    """What a task's vectors add to and take from the sums: part, entry, n, and the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((N_PARTS * n_entries, width), np.int64)
        counts, met = np.zeros(N_PARTS * n_entries, np.int64), np.zeros(N_PARTS * n_entries, bool)
        for batch in batches:
            n = batch.num_rows
            x = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(n, N_PARTS, width)
            old, new = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, N_PARTS) for c in ("before", "codes"))
            for p in range(N_PARTS):
                rows = np.flatnonzero(old[:, p] != new[:, p])
                for of, sign in ((old, -1), (new, 1)):
                    at = of[rows, p].astype(np.int64)
                    use = at >= 0
                    places, part = at[use] + p * n_entries, x[rows[use], p]
                    np.add.at(counts, places, sign)
                    np.add.at(sums, places, sign * part)
                    met[places] = True
        at = np.flatnonzero(met)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at // n_entries), pa.array(at % n_entries), pa.array(counts[at]), lists(sums[at])], ["part", "entry", "n", "sums"])

    return run


def added_up(state: DataFrame, width: int, n_entries: int) -> list:
    """The changes of all tasks by entry: N_PARTS * N_ENTRIES rows at most."""
    each = state.select("values", "before", "codes").mapInArrow(changes(width, n_entries), "part long, entry long, n long, sums array<long>")
    # decimals: no number of rows overflows
    total = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()


def train(vectors: DataFrame, counters=None, skip: bool = True) -> tuple[DataFrame, np.ndarray]:
    """The last state (vec_id, label, codes, errors ...) of all usable vectors, and the codebooks. `skip` False: every round scans everything."""
    rows, width = usable(vectors)
    rows = staged(rows, "vectors")
    books = first_codebooks(rows, width)
    n_entries = books.shape[1]
    if not n_entries:
        return rows.selectExpr("*", "cast(null as array<int>) codes", "cast(null as array<float>) bounds", "cast(null as array<long>) errors"), books
    groups = np.stack([grouped(b) for b in books])
    sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], object)
    state, moved = rows, None
    schema = f"{STATE}, before array<int>"
    for k in range(N_ROUNDS + 1):
        last = state
        state = staged(state.mapInArrow(round_of(width, books, groups, moved if skip else None, counters), schema), "round")
        discard(last)
        if k == N_ROUNDS:
            return state, books
        if not skip:
            sums[:], counts[:] = 0, 0
        for r in added_up(state, width, n_entries):
            counts[r["part"], r["entry"]] += r["n"]
            sums[r["part"], r["entry"]] += np.array([int(r[f"s{i}"]) for i in range(width)], object)
        after = books.copy()
        for p, e in zip(*np.nonzero(counts), strict=True):
            after[p, e] = [int(s) // int(counts[p, e]) for s in sums[p, e]]
        step = (after - books).astype(np.float64)
        moved = np.nextafter(np.sqrt((step * step).sum(2)) * (1 + 2.0**-50), np.inf)
        books = after
    raise AssertionError


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row."""
    state, books = train(vectors)
    hexes = F.concat(*(F.lpad(F.lower(F.hex(F.col("codes")[p])), 2, "0") for p in range(N_PARTS)))
    error = F.aggregate("errors", F.lit(0).cast("long"), lambda a, x: a + x)
    # sums by label come first; a label of many rows meets them in a broadcast, so its rows do not meet in a task
    keyed = state.select("vec_id", hexes.alias("code"), error.alias("error"), F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit(0)).alias("label"))
    by_label = keyed.groupBy("no_label", "label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("copies"))
    found = looked_up(keyed, by_label, ["no_label", "label"], "copies", max(1, keyed.count()))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_yinyang_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """The rounds, spelt out one after the other, with every distance measured."""
    rounds = []
    for k in range(N_ROUNDS + 1):
        rounds.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, d * {N_ENTRIES} + entry) AS entry, min(d) AS d
  FROM (SELECT vec_id, x.part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN b{k} ON x.part = b{k}.part AND x.pos = b{k}.pos GROUP BY ALL) GROUP BY ALL)""")
        if k < N_ROUNDS:
            rounds.append(f"""
b{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS c
  FROM b{k} LEFT JOIN (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM x JOIN a{k} USING (vec_id, part) GROUP BY ALL) USING (part, entry, pos))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (n // {N_PARTS}) AS part, (i - 1) % (n // {N_PARTS}) AS pos, floor({SCALE} * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {N_ENTRIES}),
b0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM x JOIN first USING (vec_id)),{",".join(rounds)},
e AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{N_ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{N_ROUNDS}) AS codebooks_sha256
FROM e JOIN kept USING (vec_id)
"""
