"""Every registered query with SQL, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import difference, duck

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(name, spark, sf, con):
    assert difference(entry.queries()[name](spark, sf), con.sql(ORACLES[name])) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 126
