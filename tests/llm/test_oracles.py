"""Corpus queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from quirefold.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(tuple(map(str, r)) for r in df.select(columns).collect())
    assert rows == sorted(tuple(map(str, r)) for r in want.fetchall())
