"""All queries of the catalogue against the same in SQL."""

import duckdb
import pytest

from tallyspark import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("events", "lineitem", "orders", "customer")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    want = sql.sql(catalog.SQL[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    expected = want.order("all").fetchall() if not columns else want.fetchall()
    places = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in places)) for r in expected)


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql())
