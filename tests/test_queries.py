"""Every named query against its SQL twin on whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.plans.catalog import QUERIES
from textloom.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, duck, name):
    result = duck.execute(entry.oracle_sql()[name])
    columns, rows = [d[0] for d in result.description], result.fetchall()
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, rows)


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
