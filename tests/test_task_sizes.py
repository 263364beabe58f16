"""Steps whose tasks must not grow with the table."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.stream_checks import ROWS_PER_FILE, pieces
from evenhand.models import leafwise, lowrank
from evenhand.operators.margins import margins
from evenhand.sources.sinks import write_table
from evenhand.workspace import fresh_path, portion


def test_partitioned_tables_are_written_by_tasks_of_one_value(spark):
    path = fresh_path(spark, "parts")
    rows = spark.range(0, 20_000, 1, 8).select("id", (F.col("id") % 2).alias("kind"))
    write_table(rows, path, partition_by=("kind",))
    assert spark.read.parquet(path).agg(F.count("*"), F.sum("id")).first()[:] == (20_000, 19_999 * 10_000)
    # Without an exchange each of the 8 tasks sorts all it read by kind and writes a file of each.
    for kind in (0, 1):
        assert len([f for f in os.listdir(f"{path}/kind={kind}") if f.endswith(".parquet")]) < 8


def test_rows_are_dealt_to_tasks_of_bounded_size(spark):
    rows = spark.range(0, 1000, 1, 2)
    assert portion(rows, 1000, 100).rdd.getNumPartitions() == 10 and portion(rows, 1000, 100).count() == 1000
    assert portion(rows, 1000, 500).rdd.getNumPartitions() == 2 and portion(rows, 0).rdd.getNumPartitions() == 2


def test_landing_files_do_not_grow():
    assert pieces(0, 2) == pieces(2 * ROWS_PER_FILE, 2) == 1 and pieces(2 * ROWS_PER_FILE + 1, 2) == 2


def test_margins_add_up_from_cells(spark):
    rows = spark.createDataFrame(
        [([(1, "a", 1), (1, "b", 0), (None, "a", None)],), ([(1, "a", 0)],), (None,), ([],)],
        "members array<struct<h:int,s:string,won:long>>")
    table = margins(rows, ["h", "s"])
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "array_distinct" not in plan
    got = {(r.grouping_id, r.h, r.s): (r.games, r.wins, r.trials) for r in table.collect()}
    assert got[3, None, None] == (4, 1, 2) and got[1, 1, None] == (3, 1, 2) and got[1, None, None] == (1, 0, 1)
    assert got[2, None, "a"] == (3, 1, 2) and got[0, 1, "b"] == (1, 0, 1) and len(got) == 8


def test_sides_are_read_without_python_objects():
    sides = pa.array([[9, 9], [1, 2], [3, 4]], pa.list_(pa.int32()))
    assert lowrank._matrix(sides.slice(1)).tolist() == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        lowrank._matrix(pa.array([[1, 2], [3]], pa.list_(pa.int32())))


def test_a_chain_of_splits_finds_every_leaf():
    depth = 5
    col = np.array([k // 2 if k % 2 == 0 and k < 2 * depth else -1 for k in range(2 * depth + 1)])
    inner = col >= 0
    numbers = np.arange(len(col))
    tree = leafwise.Tree(col, np.ones(len(col), int), np.where(inner, numbers + 2, 0), np.where(inner, numbers + 1, 0), numbers.astype(float))
    dense = leafwise._dense(np.array([0, 3, 4]), np.array([1.0, 1.0, -1.0]), np.array([1, 1, 1, 0]), depth)
    assert dense.flags.f_contiguous and tree.leaf_of(dense).tolist() == [1, 7, 10, 10]
