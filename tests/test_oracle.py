"""Every registered query against its DuckDB oracle on the driver tables
(row count, column names, order-insensitive values)."""

import pytest

import __spark_entry__ as entry
import martlet.checking as checking
from martlet.checking import compare, duckdb_connection

# Doubles must match bit for bit (the engines compute exact decimals, then cast).
checking.EXACT = True

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()
KEYS = sorted(entry.REGISTRY)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duckdb_connection(sf_dir)


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(ORACLE)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf_dir, con, key):
    df = QUERIES[key](spark, sf_dir)
    report = compare(df, con, ORACLE[key])
    assert report["match"], report


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["category", "total_orders", "total_quantity", "total_sales",
                          "total_profit", "avg_sales"]
