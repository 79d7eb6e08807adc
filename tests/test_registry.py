"""Registered queries: names, and agreement with SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUICK = ["candle_rollup", "page_consolidation", "series_gaps", "cost_arithmetic",
         "language_mapping", "url_canonicalisation", "gap_ranges", "exact_quantiles"]


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", QUICK)
def test_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = rows_of(entry.queries()[name](spark, SF).toPandas())
    want = rows_of(duck.sql(entry.oracle_sql()[name]).df())
    assert got.equals(want)
