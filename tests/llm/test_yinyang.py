import hashlib
import math

import numpy as np
import pytest

from litomics.llm import yinyang

SCHEMA = "vec_id long, embedding array<float>, label int, code string, values string"


def plain(rows):
    """Rows by a full scan in whole numbers."""
    rows = [r for r in rows if r[1] is not None and not any(c is None or not math.isfinite(c) for c in r[1])]
    ints = [[math.floor(1024 * c) for c in map(float, r[1])] for r in rows]
    ints = [v + [0] * (-len(v) % 4) for v in ints]
    x = np.array(ints, np.int64).reshape(len(rows), 4, -1)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ints[i]))
    books = np.array([x[i] for i in order[:256]]).transpose(1, 0, 2)
    for k in range(5):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        codes = d.argmin(2)
        if k == 4:
            break
        books = books.copy()
        for p in range(4):
            for e in range(books.shape[1]):
                own = x[codes[:, p] == e, p]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(0)]
    errors = d.min(2).sum(1)
    labels = {}
    for r, e in zip(rows, errors, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()
    return sorted(str((r[0], bytes(c.tolist()).hex(), int(e), labels[r[2]], sha)) for r, c, e in zip(rows, codes, errors, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "v") for r in rows], SCHEMA)


def found(df):
    return sorted(str(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256"))) for r in yinyang.encode(df).collect())


def vectors(n, width, seed, step=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (12, width))
    x = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.05, (n, width))
    if step:
        x = np.round(x / step) * step
    return [(i, [float(np.float32(c)) for c in v], None if i % 11 == 0 else i % 3) for i, v in enumerate(x)]


@pytest.mark.parametrize("n, width, step", [(700, 16, None), (900, 8, 1 / 32), (40, 16, None), (500, 10, None), (300, 4, 0.25)])
def test_against_plain(spark, n, width, step):
    """Coarse steps make many equal distances and repeated entries."""
    rows = vectors(n, width, n, step)
    rows += [(n + 1, None, 1), (n + 2, [None, *[0.5] * (width - 1)], 1), (n + 3, [float("nan")] * width, None), (n + 4, [float("inf"), *[0.0] * (width - 1)], 2), rows[3], (None, rows[5][1], None)]
    assert found(frame(spark, rows)) == plain(rows)


def test_hot_vector_and_hot_label(spark):
    rows = vectors(400, 16, 5) + [(1000 + i, [0.25] * 16, 7) for i in range(300)]
    assert found(frame(spark, rows)) == plain(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, 90_000, 8)], 0) for i in range(400)]
    assert found(frame(spark, rows)) == plain(rows)


def test_defined_cases(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, None, 0)])) == []
    rows = [(i, [0.1 * i] * 4, 0) for i in range(9)]
    odd = [(20, [0.5], 0), (21, [], 0), (22, [3e30] * 4, 0)]
    assert found(frame(spark, rows + odd)) == plain(rows)
    assert found(frame(spark, [(7, [0.5] * 4, None)])) == plain([(7, [0.5] * 4, None)])


def test_bounds_skip_and_change_nothing(spark):
    rows = frame(spark, vectors(3000, 16, 9))
    results, measured = [], []
    for skip in (True, False):
        acc = spark.sparkContext.accumulator(0)
        state, books = yinyang.train(rows, acc, skip)
        results.append((sorted(map(str, state.select("vec_id", "codes", "errors").collect())), books.tolist()))
        measured.append(acc.value)
    assert results[0] == results[1]
    assert measured[0] < 0.6 * measured[1]


def test_bounds_are_below_every_other_distance():
    rng = np.random.default_rng(4)
    x, entries = rng.integers(-300, 300, (200, 6)), rng.integers(-300, 300, (64, 6))
    groups = yinyang.grouped(entries)
    codes, d, bounds, _ = yinyang.assign_part(x, entries, groups, None, np.zeros((200, 16), np.float32), None)
    later = entries + rng.integers(-20, 20, entries.shape)
    moved = np.sqrt(((later - entries) ** 2).sum(1).astype(float)) + 1e-9
    codes, d, bounds, measured = yinyang.assign_part(x, later, groups, codes, bounds, moved)
    every = ((x[:, None] - later[None]) ** 2).sum(2)
    assert (codes == every.argmin(1)).all() and (d == every.min(1)).all() and measured < every.size
    for g in range(16):
        others = np.where((groups[None] == g) & (np.arange(64)[None] != codes[:, None]), every, np.inf).min(1)
        assert (bounds[:, g] <= np.sqrt(others)).all()
