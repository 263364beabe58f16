"""Registered queries of the follow-up study, reconciliation, verdict table and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.ctes import binomial, wilson
from checks.registry import check
from evenhand import schemas
from evenhand.operators import followup as fu
from evenhand.operators import rates as ra
from evenhand.operators import reconcile as rc
from evenhand.operators import significance as sg
from evenhand.operators import trials as tr
from evenhand.operators.verdicts import verdict_view
from evenhand.sources import readers, sinks
from evenhand.workspace import fresh_path, settle

LO, HI = wilson("wins", "games")

# Halves of the trials as before and after snapshots; the first carries the verdicts.
SNAPSHOTS = f"""
    halves AS (SELECT match_id % 2 AS half, hero_id, COUNT(*) AS games, CAST(SUM(won) AS BIGINT) AS wins,
        SUM(won) / CAST(COUNT(*) AS DOUBLE) AS win_rate FROM facts GROUP BY 1, 2),
    mine AS (SELECT h.*, d.name, CASE WHEN {LO} > 0.51 THEN 'nerf candidate'
        WHEN {HI} < 0.49 THEN 'buff candidate' ELSE 'within tolerance' END AS action
        FROM halves h JOIN heroes d USING (hero_id) WHERE half = 0),
    moved AS (SELECT m.hero_id, m.name, m.action, m.win_rate AS before_rate, l.win_rate AS after_rate,
        (l.win_rate - m.win_rate) * 100 AS delta_pp, (m.win_rate - 0.5) * 100 AS off_pp,
        CASE m.action WHEN 'nerf candidate' THEN -1 WHEN 'buff candidate' THEN 1 ELSE 0 END AS predicted_dir,
        CAST(sign(l.win_rate - m.win_rate) AS INT) AS actual_dir,
        CASE m.hero_id % 16 WHEN 0 THEN 'nerf' WHEN 1 THEN 'buff' WHEN 2 THEN 'mixed' WHEN 3 THEN 'neutral'
             ELSE 'untouched' END AS patch_touched
        FROM mine m JOIN halves l ON m.hero_id = l.hero_id AND l.half = 1),
    line AS (SELECT regr_slope(delta_pp, off_pp) AS b, regr_intercept(delta_pp, off_pp) AS a
        FROM moved WHERE action = 'within tolerance'),
    residuals AS (SELECT hero_id, predicted_dir, a + b * off_pp AS null_predicted_delta,
        delta_pp - (a + b * off_pp) AS residual_vs_null FROM moved, line WHERE predicted_dir <> 0),
    beats AS (SELECT *, CASE WHEN predicted_dir = 1 THEN residual_vs_null > 0 ELSE residual_vs_null < 0 END
        AS residual_beats_null FROM residuals)
"""


def snapshot(spark, sf, half: int):
    counts = ra.count_outcomes(fx.facts(spark, sf).filter(F.col("match_id") % 2 == half), ["hero_id"])
    return counts.withColumn("win_rate", ra.rate())


def moved(spark, sf):
    named = snapshot(spark, sf, 0).join(fx.heroes(spark, sf).select("hero_id", "name"), "hero_id")
    audited = sg.with_verdict(sg.with_interval(named), tolerance=0.01)
    merged = fu.merge_snapshots(audited, snapshot(spark, sf, 1))
    return fu.with_movement(fu.with_change_notes(merged, fx.change_notes(spark, sf), "name"))


def r7(*names: str):
    return [F.round(n, 7).alias(n) for n in names]


@check("j3_j4_t14_movement", f"""WITH {SNAPSHOTS}
    SELECT hero_id, action, round(delta_pp, 7) AS delta_pp, round(off_pp, 7) AS mine_offset_pp, predicted_dir, actual_dir,
        CASE WHEN predicted_dir <> 0 THEN actual_dir = predicted_dir END AS matches_prediction, patch_touched FROM moved""")
def t14(spark, sf):
    return moved(spark, sf).select("hero_id", "action", *r7("delta_pp", "mine_offset_pp"), "predicted_dir", "actual_dir",
                                   "matches_prediction", "patch_touched")


@check("t15_direction_test", f"""WITH {SNAPSHOTS}, c AS (SELECT COUNT(*) AS n,
        COUNT(*) FILTER (actual_dir = predicted_dir) AS hits FROM moved WHERE predicted_dir <> 0)
    SELECT n, hits, round({binomial('hits', 'n')}, 9) AS p_value FROM c""")
def t15(spark, sf):
    return fu.hit_test(fu.flagged(moved(spark, sf)), "matches_prediction").withColumn("p_value", F.round("p_value", 9))


@check("t16_null_residuals", f"""WITH {SNAPSHOTS}
    SELECT hero_id, round(null_predicted_delta, 7) AS null_predicted_delta,
        round(residual_vs_null, 7) AS residual_vs_null, residual_beats_null FROM beats""")
def t16(spark, sf):
    return fu.null_residuals(settle(moved(spark, sf), "moved")).select(
        "hero_id", *r7("null_predicted_delta", "residual_vs_null"), "residual_beats_null")


@check("t16_beats_null_test", f"""WITH {SNAPSHOTS}, c AS (SELECT COUNT(*) AS n,
        COUNT(*) FILTER (residual_beats_null) AS hits FROM beats)
    SELECT n, hits, round({binomial('hits', 'n')}, 9) AS p_value FROM c""")
def t16_test(spark, sf):
    residuals = fu.null_residuals(settle(moved(spark, sf), "moved"))
    return fu.hit_test(residuals, "residual_beats_null").withColumn("p_value", F.round("p_value", 9))


@check("a8_reversion_line", f"""WITH {SNAPSHOTS}
    SELECT COUNT(*) AS n, round(regr_slope(delta_pp, off_pp), 8) AS slope, round(regr_intercept(delta_pp, off_pp), 8) AS intercept,
        round(corr(delta_pp, off_pp), 8) AS r FROM moved""")
def a8(spark, sf):
    return fu.reversion(moved(spark, sf)).select("n", *[F.round(c, 8).alias(c) for c in ("slope", "intercept", "r")])


@check("a17_control_counts", f"""WITH {SNAPSHOTS}
    SELECT COUNT(*) AS n_flagged, COUNT(*) FILTER (patch_touched <> 'untouched') AS n_touched,
        COUNT(*) FILTER (patch_touched = 'untouched') AS n_untouched FROM moved WHERE predicted_dir <> 0""")
def a17(spark, sf):
    return fu.control_counts(moved(spark, sf))


@check("p11_unmatched_entities", """
    SELECT DISTINCT hero_id FROM facts WHERE hero_id NOT IN (SELECT hero_id FROM heroes)""")
def p11(spark, sf):
    return fu.unmatched(snapshot(spark, sf, 0), fx.heroes(spark, sf))


@check("r1_differences", """
    SELECT hero_id, CASE WHEN hero_id % 20 = 0 THEN 'only published' WHEN hero_id % 20 = 1 THEN 'only computed'
        WHEN hero_id % 20 = 2 THEN 'differs: win_rate' ELSE 'differs: games' END AS status
    FROM rates WHERE hero_id % 20 < 4""")
def r1(spark, sf):
    published = settle(fx.rates(spark, sf), "published")
    kind = F.col("hero_id") % 20
    computed = published.filter(kind != 0).withColumns({
        "win_rate": F.when(kind == 2, F.col("win_rate") + 1e-6).otherwise(F.col("win_rate") + 1e-13),
        "games": F.when(kind == 3, F.col("games") + 1).otherwise(F.col("games")),
    })
    return rc.differences(published.filter(kind != 1), computed, ["hero_id"], {"games": 0, "win_rate": 1e-9})


# All trials against a copy with dropped, added and changed rows.
@check("r1_differences_by_digest", """
    SELECT * FROM (SELECT match_id, CASE WHEN match_id % 911 = 0 THEN 'only published' WHEN match_id % 911 = 1 THEN 'differs: duration'
        WHEN match_id % 911 = 2 THEN 'differs: bracket, radiant_win' END AS status FROM trials
    UNION ALL SELECT -match_id, 'only computed' FROM trials WHERE match_id % 911 = 3) WHERE status IS NOT NULL""")
def r1_digest(spark, sf):
    columns = ("match_id", "duration", "bracket", "radiant_win")
    published = settle(fx.trials(spark, sf).select(*columns), "published")
    kind = F.col("match_id") % 911
    computed = published.filter(kind != 0).withColumns({
        "duration": F.when(kind == 1, F.col("duration") + 1).otherwise(F.col("duration")),
        "bracket": F.when(kind != 2, F.col("bracket")),
        "radiant_win": F.when(kind == 2, 1 - F.col("radiant_win")).otherwise(F.col("radiant_win"))})
    added = published.filter(kind == 3).withColumn("match_id", -F.col("match_id"))
    return rc.differences_by_digest(
        published, computed.unionByName(added), ["match_id"], {"duration": 0, "bracket": 0, "radiant_win": 0})


@check("p10_f6_f7_verdict_view", """
    SELECT name AS hero, format('{:,}', games) AS games, printf('%.2f%%', win_rate * 100) AS win_rate,
        printf('[%.2f%%, %.2f%%]', ci_low * 100, ci_high * 100) AS interval_95,
        CASE WHEN q_value < 0.001 THEN printf('%.2e', q_value) ELSE printf('%.4f', q_value) END AS q_value, action AS verdict
    FROM verdicts WHERE regexp_matches(name, 'A.*[0-9]', 'i')""")
def p10(spark, sf):
    from checks.audit_checks import verdict_table
    return verdict_view(verdict_table(spark, sf), search="A.*[0-9]", ordered=False)


@check("p10_over_and_under", """
    SELECT name AS hero, action AS verdict FROM verdicts WHERE action <> 'within tolerance'""")
def p10_split(spark, sf):
    from checks.audit_checks import verdict_table
    tests = settle(verdict_table(spark, sf), "verdicts")
    return fx.union_all([verdict_view(tests, v, ordered=False) for v in ("over", "under")]).select("hero", "verdict")


# --- files: written from the given tables, read back, compared with the SQL ------------------


@check("s1_s5_export_round_trip", "SELECT * FROM raw_matches")
def s1(spark, sf):
    path = fresh_path(spark, "export")
    out = fx.export(spark, sf).select(*schemas.TRIAL_EXPORT.fieldNames())
    out.write.options(header=True, compression="gzip").csv(path)
    return readers.read_trial_export(spark, path)


@check("s2_dimension_round_trip", "SELECT hero_id, name, primary_attr, attack_type, roles FROM heroes")
def s2(spark, sf):
    path = fresh_path(spark, "heroes")
    sinks.write_table(fx.heroes(spark, sf), path, "csv")
    return readers.read_dimension(spark, path)


@check("s4_latest_snapshot", """
    SELECT hero_id, COUNT(*) AS picks, CAST(SUM(won) AS BIGINT) AS wins FROM facts WHERE match_id % 2 = 1 GROUP BY 1""")
def s4(spark, sf):
    # Dates go into directory names here, since Spark names the part files.
    path = fresh_path(spark, "live")
    for half, date in ((0, "2026-07-29"), (1, "2026-08-01")):
        out = snapshot(spark, sf, half).select(
            "hero_id", F.lit("").alias("name"), F.col("games").alias("picks"), "wins", "win_rate")
        sinks.write_table(out, f"{path}/live_{date}", "csv")
    return readers.read_latest_snapshot(spark, f"{path}/live_*").select("hero_id", "picks", "wins")


@check("s6_s7_report_round_trip", """
    SELECT COUNT(*) AS matches, CAST(SUM(radiant_win) AS BIGINT) AS radiant_wins FROM trials""")
def s6(spark, sf):
    path = fresh_path(spark, "report")
    side = ra.side_balance(fx.trials(spark, sf))
    sinks.write_report(side.select(F.lit(0.05).alias("alpha"), F.struct("*").alias("side_balance")), path)
    return readers.read_report(spark, path).select("side_balance.matches", "side_balance.radiant_wins")


@check("s9_stored_facts", "SELECT bracket, side, COUNT(*) AS n, CAST(SUM(won) AS BIGINT) AS won FROM facts GROUP BY 1, 2")
def s9(spark, sf):
    path = fresh_path(spark, "facts")
    sinks.write_table(fx.facts(spark, sf), path, partition_by=("bracket",))
    stored = spark.read.parquet(path).withColumn("bracket", F.col("bracket").cast("bigint"))
    return stored.groupBy("bracket", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("won"))


# --- the same operators on native tables -------------------------------------------------------


@check("native_supplier_returns", f"""
    WITH f AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem),
    g AS (SELECT l_suppkey, COUNT(*) AS games, CAST(SUM(returned) AS BIGINT) AS wins FROM f GROUP BY 1)
    SELECT l_suppkey, s_name AS name, games, wins, round({LO}, 9) AS ci_low, round({HI}, 9) AS ci_high
    FROM g JOIN supplier ON l_suppkey = s_suppkey""")
def native_returns(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    counts = ra.count_outcomes(lines, ["l_suppkey"], won="returned")
    suppliers = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    rated = ra.entity_rates(counts, suppliers, fx.table(spark, sf, "orders"), "l_suppkey", ["name"])
    return sg.with_interval(rated).select("l_suppkey", "name", "games", "wins", *[F.round(c, 9).alias(c) for c in ("ci_low", "ci_high")])


@check("native_user_purchases", """
    SELECT user_id, COUNT(*) AS games, COUNT(*) FILTER (event_type = 'purchase') AS wins FROM events GROUP BY 1""")
def native_purchases(spark, sf):
    events = fx.table(spark, sf, "events").select(
        "user_id", (F.col("event_type") == "purchase").cast("bigint").alias("bought"))
    return ra.count_outcomes(events, ["user_id"], won="bought")
