"""Every registered query against its DuckDB oracle on sf0.001: same columns,
same row count, same rows (order-insensitive)."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import VIEWS, digest
from hubflow.plans.queries import QUERIES
from tests.conftest import SF_SMALL

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM '{SF_SMALL}/{v}.parquet'")
    return con


def test_every_query_has_oracle_sql():
    assert set(KEYS) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    got = entry.queries()[key](spark, SF_SMALL).toPandas()
    want = duck.sql(entry.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert digest(got) == digest(want)


def test_entry_flagship(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 38
    assert df.count() > 0


def test_entry_schema_is_stable(spark):
    assert entry.entry(spark).schema == entry.entry(spark).schema
