"""Every query of the core against its SQL. The extract has several documents at every size."""

import duckdb
import pytest

from wayweft.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR)
    want = duck.sql(registry.ORACLES[name]).to_arrow_table()
    columns = sorted(got.columns)
    assert columns == sorted(want.column_names)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted((tuple(r[c] for c in columns) for r in want.to_pylist()), key=key)
