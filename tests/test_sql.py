"""Registered queries against their SQL in DuckDB on the smallest tables.

A spread of the queries runs by default; ALL_QUERIES=1 runs every one.
"""

import os

import duckdb
import pytest

import __spark_entry__ as e
import tools_check

SF = "/root/testdata/sf0.001"
NAMES = sorted(e.oracle_sql())
if not os.environ.get("ALL_QUERIES"):
    NAMES = NAMES[::6]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in tools_check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name, monkeypatch):
    monkeypatch.setattr(tools_check, "SF", SF)
    line = tools_check.compare(spark, con, name)
    assert line.startswith("ok"), line


def test_every_query_has_a_name_once_and_sql_belongs_to_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    df = e.entry(spark)
    assert df.count() == 6000
    assert "price_ma_90" in df.columns
