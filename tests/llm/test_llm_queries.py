"""The registered queries and the pipeline on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from textloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = {"6": "embeddings", "8": "embeddings", "1": "pages", "7": "pages"}


#: Queries whose number of rows only their SQL twin knows.
BY_SQL = ("op12_", "op13_")


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(BY_SQL)])
def test_query_runs_over_its_whole_table(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    table = TABLES.get(name[2:].split("_")[0], "documents")
    count = spark.read.parquet(f"{SF}/{table}.parquet").count()
    if table == "embeddings":
        ids = [r["vec_id"] for r in spark.read.parquet(f"{SF}/{table}.parquet").collect()]
        assert len(rows) == sum(min(10, len(ids) - 1) for i in ids if i % 100 == 0)
    else:
        assert len(rows) == count


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    result = duck.execute(ORACLES[name])
    columns, want = [d[0] for d in result.description], result.fetchall()
    got = QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        got = kept.collect()
        assert got and all(tuple(r) == rows[r["doc_id"]] for r in got), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(rows) and "ids_sha256" in last.columns
    assert corpus_pipeline.run(spark, SF).count() > 0
