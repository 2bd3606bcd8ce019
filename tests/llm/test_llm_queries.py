"""The registered queries against their SQL in DuckDB, and the pipeline."""

import math

import duckdb
import pytest

import corpus_pipeline
from firmwatt.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "labels", "pages", "conversations", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = duck.execute(oracles.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())


def test_pipeline_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, queries_stage(function(spark, docs, SF))
        assert docs.columns == before.columns, name
    packed = corpus_pipeline.run(spark, SF).collect()
    totals = {(r["doc_id"], r["start"]): r["length"] for r in packed}
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    windows: dict[int, int] = {}
    for r in packed:
        windows[r["sequence_id"]] = windows.get(r["sequence_id"], 0) + r["length"]
    assert totals and max(windows.values()) <= 2048
    assert len(windows) <= math.ceil(sum(windows.values()) / 2048 * 1.1) + 1


def queries_stage(df):
    from firmwatt.llm.common import stage

    return stage(df)
