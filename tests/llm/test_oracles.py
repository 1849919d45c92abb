"""The queries of this subpackage that SQL can express, against that SQL."""

import duckdb
import pytest

from litomics.llm.queries import ORACLES, QUERIES

from ..test_oracles import SF, TABLES, rows_of


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    found = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(found.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(found.columns, found.fetchall())
