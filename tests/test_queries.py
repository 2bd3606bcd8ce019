"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as registered
from firmwatt.checks import oracles
from firmwatt.checks import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
QUERIES, SQL = engine.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def _table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = [tuple("" if r[i] is None else str(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(text)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert _table(df.columns, rows) == _table(columns, cursor.fetchall())


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


def test_all_are_registered():
    assert set(QUERIES) <= set(registered.queries()) and set(SQL) <= set(registered.oracle_sql())


def test_entry(spark):
    assert registered.entry(spark).count() == 120
