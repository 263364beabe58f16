"""Comparison by digests gives what the full comparison gives."""

import pytest
from pyspark.sql import functions as F

from evenhand.operators import reconcile as rc

SCHEMA = "k string, n long, x double"
ROWS = [("a", 1, 1.0), ("b", 2, None), (None, 3, 3.0), ("d", 4, float("nan")), ("e", None, 5.0), ("f", 6, 0.0), ("g", 7, 7.0), ("g", 7, 7.0)]


@pytest.mark.parametrize("groups", [1, 3, 1024])
@pytest.mark.parametrize("other", [
    ROWS, [], ROWS[1:], ROWS[:-1], [("a", 1, 1.0 + 1e-12), *ROWS[1:]], [("a", 1, 1.1), *ROWS[1:]],
    [*ROWS[:2], (None, 4, 3.0), *ROWS[3:]], [("z", 1, 1.0), *ROWS[1:]], [*ROWS[:4], ("e", 0, 5.0), *ROWS[5:]]])
def test_same_as_full_comparison(spark, other, groups):
    tolerance = {"n": 0, "x": 1e-9}
    left, right = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(other, SCHEMA)
    found = rc.differences_by_digest(left.withColumn("extra", F.rand()), right, ["k"], tolerance, groups)
    full = rc.differences(left, right, ["k"], tolerance)
    assert sorted(map(str, found.collect())) == sorted(map(str, full.collect()))


def test_types_of_both_sides_may_differ(spark):
    left = spark.createDataFrame([(1, 5), (2, 6)], "k int, n int")
    right = spark.createDataFrame([(1, 5), (2, 7)], "k long, n long")
    assert [tuple(r) for r in rc.differences_by_digest(left, right, ["k"], {"n": 0}).collect()] == [(2, "differs: n")]
