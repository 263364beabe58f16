"""Registered queries of joins in time, margins with distinct counts, and stored sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import check
from evenhand.operators import margins as mg
from evenhand.operators import sketches as sk
from evenhand.operators import temporal as te

EPOCH, SPAN = 1785283200, 60_000  # of the export's start times


def notes(spark, sf):
    """Change notes, one or more for each entity, all over the time of the trials."""
    key = F.col("p_partkey")
    return fx.table(spark, sf, "part").select(
        (1 + key % 127).cast("int").alias("hero_id"), (EPOCH + key * 7919 % SPAN).alias("noted_at"), key.alias("note"))


NOTES = f"""(SELECT 1 + p_partkey % 127 AS hero_id, {EPOCH} + p_partkey * 7919 % {SPAN} AS noted_at, max(p_partkey) AS note
    FROM part GROUP BY ALL)"""


def timed_facts(spark, sf):
    return fx.facts(spark, sf).withColumn("at", EPOCH + F.col("match_id"))


@check("j10_note_in_force", f"""
    SELECT match_id, side, f.hero_id, noted_at, note FROM (SELECT *, {EPOCH} + match_id AS moment FROM facts) AS f
    ASOF LEFT JOIN {NOTES} AS n ON f.hero_id = n.hero_id AND f.moment >= n.noted_at""")
def note_in_force(spark, sf):
    return te.as_of_join(timed_facts(spark, sf), notes(spark, sf), "at", "noted_at", ["hero_id"]).select("match_id", "side", "hero_id", "noted_at", "note")


@check("j10_recent_note", f"""
    SELECT match_id, side, f.hero_id, CASE WHEN f.moment - noted_at <= 9000 THEN note END AS note
    FROM (SELECT *, {EPOCH} + match_id AS moment FROM facts) AS f
    ASOF LEFT JOIN {NOTES} AS n ON f.hero_id = n.hero_id AND f.moment >= n.noted_at""")
def recent_note(spark, sf):
    """Notes older than 9,000 seconds no longer count."""
    return te.as_of_join(timed_facts(spark, sf), notes(spark, sf), "at", "noted_at", ["hero_id"], within=9000).select("match_id", "side", "hero_id", "note")


@check("j10_trials_in_periods", f"""
    SELECT period, CAST(COUNT(*) AS BIGINT) AS trials, CAST(SUM(radiant_win) AS BIGINT) AS wins FROM trials JOIN
        (SELECT c_custkey AS period, {EPOCH} + c_custkey * 911 % {SPAN} AS opens, 1 + c_custkey * 37 % 3000 AS seconds FROM customer)
        ON start_time >= opens AND start_time < opens + seconds
    GROUP BY 1""")
def trials_in_periods(spark, sf):
    """Trials and wins of overlapping periods from a second to most of an hour."""
    key = F.col("c_custkey")
    periods = fx.table(spark, sf, "customer").select(key.alias("period"), (EPOCH + key * 911 % SPAN).alias("opens")).withColumn(
        "closes", F.col("opens") + 1 + F.col("period") * 37 % 3000)
    met = te.interval_join(fx.trials(spark, sf).select("start_time", "radiant_win"), periods, "start_time", "opens", "closes")
    return met.groupBy("period").agg(F.count("*").alias("trials"), F.sum("radiant_win").alias("wins"))


@check("a19_margins", """
    SELECT GROUPING_ID(hero_id, bracket, side)::INT AS grouping_id, hero_id, bracket, side, CAST(COUNT(*) AS BIGINT) AS games,
        CAST(SUM(won) AS BIGINT) AS wins, CAST(COUNT(DISTINCT match_id) AS BIGINT) AS trials
    FROM facts GROUP BY CUBE (hero_id, bracket, side)""")
def all_margins(spark, sf):
    sides = [("radiant", F.col("radiant_team"), F.col("radiant_win")), ("dire", F.col("dire_team"), 1 - F.col("radiant_win"))]
    rows = mg.members_of(fx.trials(spark, sf), "match_id", ["bracket"], sides)
    return mg.margins(rows, ["hero_id", "bracket", "side"])


def sketched_facts(spark, sf):
    return fx.trials(spark, sf).select(
        "match_id", "bracket", "duration", (F.col("match_id") / 20_000).cast("int").alias("day"), F.explode(F.concat("radiant_team", "dire_team")).alias("hero_id"))


@check("a9_a19_sketches", """
    SELECT hero_id, CAST(COUNT(*) AS BIGINT) AS n, TRUE AS distinct_within, TRUE AS median_within, TRUE AS p90_within FROM facts GROUP BY 1""")
def sketches(spark, sf):
    """Cells by stratum, entity and day, rolled up to entities; the exact values lie within the stated bounds."""
    facts = sketched_facts(spark, sf)
    cells = sk.sketch_cells(facts, ["bracket", "hero_id", "day"], "match_id", "duration")
    told = sk.roll_up_sketches(cells, ["hero_id"]).select(
        "hero_id", "n", sk.estimated_distinct().alias("trials"), sk.estimated_quantile(0.5).alias("median"), sk.estimated_quantile(0.9).alias("p90"))
    def near(name, point):
        value = F.col("duration")
        low, high = F.count_if(value < F.col(name)) / F.count("*"), F.count_if(value <= F.col(name)) / F.count("*")
        return ((low <= point + sk.RANK_ERROR) & (high >= point - sk.RANK_ERROR)).alias(f"{name}_within")
    return facts.join(told, "hero_id").groupBy("hero_id", "n", "trials").agg(
        F.count_distinct("match_id").alias("exact"), near("median", 0.5), near("p90", 0.9)).select(
        "hero_id", "n", (F.abs(F.col("trials") - F.col("exact")) <= sk.DISTINCT_ERROR * F.col("exact")).alias("distinct_within"), "median_within", "p90_within")
