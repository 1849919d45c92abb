"""Every query with SQL, against that SQL, on the smallest tables."""

import duckdb
import pytest

from litomics.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6)
    return x if isinstance(x, (str, bool)) else int(x) if hasattr(x, "__index__") else str(x) if not hasattr(x, "as_integer_ratio") else round(float(x), 6)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(map(str, (tuple(plain(r[i]) for i in order) for r in rows)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    found = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(found.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(found.columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)
