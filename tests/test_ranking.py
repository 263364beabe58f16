"""Ranks, running totals and order statistics on the distributed path, against plain windows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evenhand.models.evaluation import area_under_roc, calibration, metrics
from evenhand.operators import ranking as rk
from evenhand.operators.significance import adjust_false_discovery


def test_global_index_over_many_ranges(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("key"))
    indexed = rk.with_global_index(df, "key", rows_per_range=100)
    plain = df.withColumn("expected", F.row_number().over(Window.orderBy("key")) - 1)
    assert indexed.join(plain, "key").filter("row_index = expected").count() == 5000


def test_running_within_groups(spark):
    df = spark.range(3000).select((F.col("id") % 4 % 3).alias("g"), F.xxhash64("id").alias("key"), (F.col("id") % 7).alias("v"))
    ranged = rk.with_range(df, ["g", "key"], 150)
    w = Window.partitionBy("g").orderBy("key")
    down = Window.partitionBy("g").orderBy(F.desc("key"))
    plain = df.select("key", F.sum("v").over(w).alias("es"), F.min("v").over(down).alias("em"))
    mine = rk.running(ranged, "key", F.col("v"), "s", ["g"]).join(
        rk.running(ranged, "key", F.col("v"), "m", ["g"], how="min", descending=True).select("key", "m"), "key")
    assert mine.join(plain, "key").filter("s = es and m = em").count() == 3000
    assert ranged.select("_range").distinct().count() > 10


@pytest.mark.parametrize("make", [
    lambda i: float(i), lambda i: i % 5, lambda i: 2**60 + i, lambda i: math.exp(-i / 20), lambda i: 7,
    lambda i: -1.5 if i % 3 else i / 7,
])
def test_order_statistics(spark, make):
    values = [make(i) for i in range(1000)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double" if isinstance(values[0], float) or isinstance(values[1], float) else "x long")
    ranks = [0, 1, 333, 500, 998, 999]
    expected = sorted(df.toPandas()["x"].dropna().tolist()) if df.schema["x"].dataType.typeName() == "double" else sorted(values)
    assert rk.order_statistics(df, "x", [*ranks, 1000], buckets=16) == {r: expected[r] for r in ranks}


def test_quantiles_interpolate_like_numpy(spark):
    values = np.random.default_rng(3).normal(size=777)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    points = [0, 0.01, 0.25, 0.5, 0.99, 1]
    assert rk.exact_quantiles(df, "x", points) == pytest.approx(np.quantile(values, points).tolist())
    assert all(math.isnan(q) for q in rk.exact_quantiles(df.limit(0), "x", [0.5]))


def brute_bh(p):
    order = np.argsort(p)
    q = np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


def test_false_discovery_with_a_third_of_equal_p_values(spark):
    rng = np.random.default_rng(5)
    p = np.where(np.arange(900) % 3 == 0, 0.25, np.round(rng.uniform(size=900) ** 3, 3))
    df = spark.createDataFrame([(i, int(i % 2), float(v)) for i, v in enumerate(p)], "id long, f int, p_value double")
    got = {r.id: r.q_value for r in adjust_false_discovery(df, rows_per_range=20).collect()}
    assert [got[i] for i in range(900)] == pytest.approx(brute_bh(p))
    by_family = {r.id: r.q_value for r in adjust_false_discovery(df, family=["f"], rows_per_range=20).collect()}
    for f in (0, 1):
        assert [by_family[i] for i in range(f, 900, 2)] == pytest.approx(brute_bh(p[f::2]))


def test_false_discovery_properties_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.01), (2, None), (3, 0.5), (4, 1.0)], "id long, p_value double")
    rows = {r.id: r for r in adjust_false_discovery(df).collect()}
    assert rows[2].q_value is None
    assert all(rows[i].q_value >= rows[i].p_value for i in (1, 3, 4))
    assert rows[1].q_value <= rows[3].q_value <= rows[4].q_value


def brute_auc(p, y):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(np.sum(a > neg) + 0.5 * np.sum(a == neg)) / len(neg) for a in pos])


def test_auc_with_a_third_of_equal_scores(spark):
    rng = np.random.default_rng(7)
    p = np.where(np.arange(600) % 3 == 0, 0.5, np.round(rng.uniform(size=600), 2))
    y = (rng.uniform(size=600) < p).astype(int)
    df = spark.createDataFrame([("m", float(a), int(b)) for a, b in zip(p, y)], "model string, p double, y int")
    assert area_under_roc(df, rows_per_range=10).first().roc_auc == pytest.approx(brute_auc(p, y))


def test_constant_predictor(spark):
    df = spark.createDataFrame([("c", 0.5, i % 2) for i in range(10)], "model string, p double, y int")
    row = metrics(df).first()
    assert (row.accuracy, row.roc_auc, row.brier) == (0.5, 0.5, 0.25)
    assert row.log_loss == pytest.approx(math.log(2))
    assert [(r.bin, r.n) for r in calibration(df).collect()] == [(0, 10)]


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("c", 0.5, 1), ("c", 0.6, 1)], "model string, p double, y int")
    assert metrics(df).first().roc_auc is None


@pytest.mark.parametrize("values", [
    [float("inf"), 1.0, float("-inf"), float("nan"), 2.0], [float("nan")], [1.7e308, -1.7e308, 0.0, 5.0], [5e-324, 0.0, 1.0],
])
def test_order_statistics_of_any_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = rk.order_statistics(df, "x", range(len(values)))
    want = sorted(values, key=lambda v: (v != v, v))
    assert [repr(got[k]) for k in range(len(values))] == [repr(v) for v in want]


def test_order_statistics_of_far_apart_longs(spark):
    values = [-(2 ** 63), 2 ** 63 - 1, 2 ** 62, 2 ** 62 + 1, 0]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert rk.order_statistics(df, "x", range(5)) == dict(enumerate(sorted(values)))
