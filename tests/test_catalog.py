"""Every query with a SQL twin gives the same rows on DuckDB."""

import os

import pytest

from quillspark.plans import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{DIR}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    df = catalog.QUERIES[name](spark, DIR)
    found = duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    mine = sorted((tuple(map(plain, row)) for row in df.select(*columns).collect()), key=repr)
    theirs = sorted((tuple(plain(row[found.columns.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    assert mine == theirs
