"""The queries that SQL can express give DuckDB's rows."""

import os

import pytest

from quillspark.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{DIR}/{table}.parquet')")
    found = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(found.columns)
    assert sorted(map(tuple, df.select(*found.columns).collect())) == sorted(found.fetchall())
