"""Validity, copies, unpivoting and their edge rows."""

import pytest
from pyspark.sql import functions as F

from evenhand import schemas
from evenhand.functions.teams import parse_team
from evenhand.operators import rates as ra
from evenhand.operators import trials as tr
from evenhand.sources import readers, sinks
from evenhand.workspace import fresh_path

A, B = [1, 2, 3, 4, 5], [6, 7, 8, 9, 10]


def landing(spark, *rows):
    return spark.createDataFrame(
        [(i, 1_785_283_200 + i, d, 7, 22, rank, win, a, b) for i, (d, rank, win, a, b) in enumerate(rows)],
        schemas.TRIAL_LANDING)


def test_reject_reasons(spark):
    df = landing(
        spark, (900, 54, True, A, B), (899, 54, True, A, B), (None, 54, True, A, B), (1000, None, True, A, B),
        (1000, 54, True, None, B), (1000, 54, True, A[:4], B), (1000, 54, True, [1, 2, 3, 4, None], B),
        (1000, 54, True, [0, 2, 3, 4, 5], B), (1000, 54, True, A, [5, 7, 8, 9, 10]), (1000, 54, None, A, B))
    reasons = [r.reject_reason for r in tr.with_reject_reason(df).orderBy("match_id").collect()]
    assert reasons == [None, "too short", "too short", "no rank", "missing team", "team size", "missing entity",
                       "missing entity", "repeated entity", None]
    assert tr.valid_trials(df).count() == 2


def test_stored_reason_is_used(spark):
    export = spark.createDataFrame(
        [(1, 0, 1000, 7, 22, 54, 1, "1 2 3 4 5", "6 7 8 9 10"), (2, 0, 1000, 7, 22, 54, 1, "1 2 3 4", "6 7 8 9 10")],
        schemas.TRIAL_EXPORT)
    landed = tr.land_export(export)
    assert [r.match_id for r in tr.valid_trials(landed).collect()] == [1]
    plan = tr.valid_trials(tr.in_mode(landed))._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(reject_reason)" in plan and "EqualTo(game_mode,22)" in plan


@pytest.mark.parametrize("text, ids", [("14 42 18", [14, 42, 18]), ("  1\t2  3 ", [1, 2, 3]), ("", [])])
def test_parse_team(spark, text, ids):
    assert spark.range(1).select(parse_team(F.lit(text)).alias("t")).first().t == ids


def test_shape_landing(spark):
    row = tr.shape_landing(landing(spark, (1000, 54, None, A, B))).first()
    assert (row.radiant_win, row.radiant_team, row.dire_team) == (0, "1 2 3 4 5", "6 7 8 9 10")


def test_facts_and_integrity(spark):
    df = tr.with_strata(landing(spark, (1000, 54, True, A, B), (1000, 71, False, B, A)).withColumn(
        "radiant_win", F.col("radiant_win").cast("int")))
    facts = tr.entity_facts(df)
    assert facts.count() == 20
    assert {(r.bracket, r.hero_id, r.won) for r in facts.filter("hero_id in (1, 6)").collect()} == {
        (5, 1, 1), (5, 6, 0), (7, 6, 0), (7, 1, 1)}
    assert tr.integrity_failures(df).count() == 0
    tr.assert_integrity(df)
    with pytest.raises(ValueError, match="wrong number"):
        tr.assert_integrity(df.unionByName(df.limit(1)))


def test_facts_read_the_source_once(spark, sf):
    from checks import fixtures as fx
    plan = fx.facts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_mostly_copied_trial_is_cut_before_the_shuffle(spark):
    base = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("match_id"))
    df = base.select("match_id", (5000 - F.col("id")).alias("start_time"), F.col("id").alias("payload"))
    first = tr.first_per_trial(df)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert first.count() == 2000
    assert first.filter("match_id = 7").first().payload == 2997


def test_mode_none_keeps_all(spark, sf):
    from checks import fixtures as fx
    df = fx.export(spark, sf)
    assert tr.in_mode(df, None).count() == df.count() > tr.in_mode(df).count()


def test_no_usable_strata_gives_no_pairs(spark):
    one = spark.createDataFrame([(1, 1, "a", 0.4), (1, 2, "b", 0.5)], "bracket long, hero_id int, name string, win_rate double")
    assert ra.low_high_pairs(one, min_entities=1).count() == 0
    assert ra.low_high_pairs(one, min_entities=60).count() == 0


def test_latest_snapshot_and_quoting(spark):
    path = fresh_path(spark, "snapshots")
    for date, picks in (("2026-07-29", 10), ("2026-08-01", 20)):
        df = spark.createDataFrame([(1, 'a "b", c', picks, 5, 0.5)], schemas.ENTITY_SNAPSHOT)
        sinks.write_table(df.coalesce(1), f"{path}/live_{date}", "csv")
    row = readers.read_latest_snapshot(spark, f"{path}/live_*").first()
    assert (row.snapshot_date, row.picks) == ("2026-08-01", 20)
