"""Where registered queries and their DuckDB counterparts are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows if there is one."""
    from checks.ctes import sql

    def register(query: Query) -> Query:
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = sql(oracle)
        return query

    return register
