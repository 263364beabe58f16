"""Joins in time, margins and sketches against brute force, on odd rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evenhand.operators import margins as mg
from evenhand.operators import sketches as sk
from evenhand.operators.temporal import as_of_join, dyadic_cover, interval_join


def timed(seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, 1, 2, 2, 2, 3]), rnd.choice([None, *range(-20, 60)])) for i in range(300)]
    notes = [(rnd.choice([None, 1, 2, 2, 2]), rnd.choice([None, *range(-30, 60)]), rnd.choice([None, "a", "b", "c"])) for _ in range(120)]
    return rows + rows[:5], notes + notes[:5]


@pytest.mark.parametrize("rows_per_range, within, seed", [(1_000_000, None, 1), (25, None, 2), (25, 4, 3)])
def test_as_of_join_by_brute_force(spark, rows_per_range, within, seed):
    """Also with ranges that cut through every key, ties in time, nulls and repeated rows."""
    rows, notes = timed(seed)
    left, right = spark.createDataFrame(rows, "id long, k int, t long"), spark.createDataFrame(notes, "k int, s long, note string")
    got = sorted(map(tuple, as_of_join(left, right, "t", "s", ["k"], within, rows_per_range).collect()), key=str)
    want = []
    for i, k, t in rows:
        held = [(s, n is not None, n) for kk, s, n in notes if None not in (k, t, kk, s) and kk == k and s <= t]
        s, _, note = max(held, key=lambda x: x[:2] + ((x[2],) if x[1] else ()), default=(None, None, None))
        want.append((i, k, t, *((None, None) if s is None or within is not None and t - s > within else (s, note))))
    assert got == sorted(want, key=str)


def test_as_of_join_without_keys_and_of_nothing(spark):
    left, right = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "id long, t int"), spark.createDataFrame([(2.5, "x"), (9.0, "y")], "s double, note string")
    got = {r["id"]: r["note"] for r in as_of_join(left, right, "t", "s").collect()}
    assert got == {1: "x", 2: "y", 3: None}
    assert as_of_join(left.limit(0), right, "t", "s").count() == 0
    assert {r["note"] for r in as_of_join(left, right.limit(0), "t", "s").collect()} == {None}
    with pytest.raises(ValueError):
        as_of_join(left, right.withColumn("id", F.lit(1)), "t", "s")


@pytest.mark.parametrize("bits", [0, 3, 8])
def test_interval_join_by_brute_force(spark, bits):
    rows, _ = timed(bits)
    rnd = random.Random(bits)
    spans = [(j, rnd.choice([None, 1, 2]), rnd.choice([None, *range(-50, 60)]), rnd.choice([-3, 0, 1, 2, 5, 40, 100])) for j in range(90)]
    spans = [(j, k, b, None if b is None else b + n) for j, k, b, n in spans] + [(500, 2, -10**15, 10**15), (500, 2, -10**15, 10**15), (501, 1, 0, None)]
    left, right = spark.createDataFrame(rows, "id long, k int, t long"), spark.createDataFrame(spans, "sid long, k int, b long, e long")
    met = interval_join(left, right, "t", "b", "e", ["k"], bits)
    want = sorted((i, j) for i, k, t in rows for j, kk, b, e in spans if None not in (k, t, b, e) and k == kk and b <= t < e)
    assert sorted((r["id"], r["sid"]) for r in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert interval_join(left.limit(0), right, "t", "b", "e", ["k"]).count() == interval_join(left, right.limit(0), "t", "b", "e", ["k"]).count() == 0


def test_cover_is_exact_and_short(spark):
    spans = [(a, a + n) for a in (-37, -1, 0, 5, 64) for n in (0, 1, 2, 7, 63, 64, 1000)]
    df = spark.createDataFrame(spans, "low long, high long").withColumn("cells", dyadic_cover(F.col("low"), F.col("high")))
    for r in df.collect():
        held = [x for c in r["cells"] for x in range(c["bucket"] << c["level"], (c["bucket"] + 1) << c["level"])]
        assert sorted(held) == list(range(r["low"], r["high"] + 1))
        assert len(r["cells"]) <= 2 * (r["high"] - r["low"] + 2).bit_length()


def test_margins_by_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, [(rnd.choice([None, 1, 2, 3]), rnd.choice("rd"), rnd.choice([None, 0, 1]), rnd.choice([None, 7, 8])) for _ in range(rnd.randrange(0, 6))]) for i in range(80)]
    rows += [(200, None), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "match_id long, members array<struct<hero_id:int,side:string,won:long,bracket:int>>")
    dims = ["hero_id", "side", "bracket"]
    at = {"hero_id": 0, "side": 1, "bracket": 3}
    for sets in (None, [("hero_id",), ()]):
        want = {}
        for kept in mg.cube(dims) if sets is None else sets:
            for row, (_, members) in enumerate(rows):
                for m in members or []:
                    key = (mg.grouping_id(kept, dims), *[m[at[d]] if d in kept else None for d in dims])
                    games, wins, trials = want.setdefault(key, [0, 0, set()])
                    want[key] = [games + 1, wins + (m[2] or 0), trials | {row}]
        got = {tuple(r[:4]): [r["games"], r["wins"], r["trials"]] for r in mg.margins(df, dims, sets).collect()}
        assert got == {k: [g, w, len(t)] for k, (g, w, t) in want.items()}
    assert mg.margins(df.limit(0), dims).count() == 0


def test_sketches_roll_up_within_their_bounds(spark):
    facts = spark.range(60_000).select(
        (F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("day"), (F.col("id") % 20_000).alias("who"),
        F.when(F.col("id") % 50 > 0, (F.col("id") * 7919) % 10_007).alias("v"))
    for by in (["k"], []):
        cells = sk.roll_up_sketches(sk.roll_up_sketches(sk.sketch_cells(facts, ["k", "day"], "who", "v"), ["k", "day"]), by)
        got = cells.select(*by, "n", sk.estimated_distinct().alias("d"), *[sk.estimated_quantile(q).alias(f"q{q}") for q in (0.1, 0.5, 0.99)]).collect()
        for r in got:
            exact = facts.filter(F.col("k") == r["k"]) if by else facts
            values = sorted(x["v"] for x in exact.filter("v is not null").collect())
            assert r["n"] == exact.count() and abs(r["d"] - 20_000) <= sk.DISTINCT_ERROR * 20_000
            for q in (0.1, 0.5, 0.99):
                rank = sum(v <= r[f"q{q}"] for v in values) / len(values)
                assert abs(rank - q) <= sk.RANK_ERROR
    empty = sk.sketch_cells(facts.withColumn("v", F.lit(None).cast("double")), ["k"], "who", "v")
    assert [r["q"] for r in empty.select(sk.estimated_quantile(0.5).alias("q")).collect()] == [None] * 3
    assert sk.roll_up_sketches(empty.limit(0), ["k"]).count() == 0


def test_cube_lists_every_set():
    assert set(mg.cube("abc")) == {s for n in range(4) for s in itertools.combinations("abc", n)}
    assert mg.grouping_id(("a",), "abc") == 3 and mg.grouping_id("abc", "abc") == 0
