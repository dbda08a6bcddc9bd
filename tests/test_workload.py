"""Every registered query against its SQL counterpart, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import check
from voilage.workload.oracles import statements
from voilage.workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    cur = db.execute(statements()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cur.fetchall())


def test_all_paired_and_named():
    assert set(QUERIES) == set(statements())
    assert set(QUERIES) <= set(entry.queries()) and set(statements()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 1000
