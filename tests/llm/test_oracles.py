"""Every query of the subpackage with SQL, against DuckDB on the smallest tables."""

import pytest

from checks.compare import difference, duck
from evenhand.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(name, spark, sf):
    assert difference(QUERIES[name](spark, sf), duck(sf).sql(ORACLES[name])) is None


def test_all_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
