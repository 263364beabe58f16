"""Registered queries of ingest, running rates, whole reports and figure data."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.audit_checks import stratum_table, verdict_table
from checks.ctes import Z, ZB, n_per_group
from checks.followup_checks import HI, LO, SNAPSHOTS, moved
from checks.model_checks import prepared
from checks.registry import check
from evenhand.models import logistic
from evenhand.operators import rates as ra
from evenhand.operators import sizing as sz
from evenhand.operators import trials as tr
from evenhand.plans import audit, figures
from evenhand.sources import readers
from evenhand.streaming import ingest as st
from evenhand.streaming import stateful
from evenhand.workspace import fresh_path, settle


ROWS_PER_FILE = 500_000


def pieces(rows: int, files: int) -> int:
    """How many landing files stand for one of `files`, so that none grows with the table."""
    return max(1, -(-rows // (files * ROWS_PER_FILE)))


def landed(spark, sf) -> str:
    """The export as landing JSON in several files, every 97th trial twice."""
    path = fresh_path(spark, "landing")
    api = fx.arrays(spark, sf).drop("reject_reason").withColumn("radiant_win", F.col("radiant_win") == 1)
    api.repartition(4).write.json(f"{path}/a")
    api.filter(F.col("match_id") % 97 == 0).write.json(f"{path}/b")
    return path


def run_ingest(spark, sf) -> str:
    landing, table = landed(spark, sf), fresh_path(spark, "trials")
    st.ingest(st.landing_stream(spark, f"{landing}/*", 3), table, fresh_path(spark, "progress")).awaitTermination()
    return table


ACCEPTED = """valid AS (SELECT * FROM listed WHERE len(r) = 5 AND len(d) = 5 AND NOT list_contains(list_concat(r, d), 0)
    AND len(list_distinct(list_concat(r, d))) = 10 AND duration >= 900 AND avg_rank_tier IS NOT NULL)"""


@check("st1_s3_ingest", f"""WITH {ACCEPTED}
    SELECT match_id, start_time, game_mode, radiant_win, array_to_string(r, ' ') AS radiant_team, CAST(avg_rank_tier // 10 AS BIGINT) AS bracket FROM valid""")
def st1(spark, sf):
    return st.stored_trials(spark, run_ingest(spark, sf)).select(
        "match_id", "start_time", "game_mode", "radiant_win", F.array_join("radiant_team", " ").alias("radiant_team"), "bracket")


def run_ingest_twice(spark, sf) -> str:
    """Half of the trials, then all of them under a new checkpoint, with copies 30 days off."""
    table = fresh_path(spark, "trials")
    api = fx.arrays(spark, sf).drop("reject_reason").withColumn("radiant_win", F.col("radiant_win") == 1)
    off = api.filter("match_id % 97 = 0").withColumn("start_time", F.col("start_time") - 30 * 86400)
    undated = api.filter("match_id % 89 = 0").withColumn("start_time", F.lit(None).cast("long"))
    for part in ([api.filter("match_id % 2 = 0")], [off, undated], [api]):
        landing = fresh_path(spark, "landing")
        many = pieces(max(df.count() for df in part), 2)
        for k, df in enumerate(part):
            df.repartition(2 * many).write.json(f"{landing}/{k}")
        st.ingest(st.landing_stream(spark, f"{landing}/*", many), table, fresh_path(spark, "progress")).awaitTermination()
    return table


@check("st1_new_checkpoints", f"WITH {ACCEPTED} SELECT match_id, radiant_win, CAST(avg_rank_tier // 10 AS BIGINT) AS bracket FROM valid")
def st1_new_checkpoints(spark, sf):
    return st.stored_trials(spark, run_ingest_twice(spark, sf)).select("match_id", "radiant_win", "bracket")


@check("st1_old_first_arrivals", f"WITH {ACCEPTED} SELECT match_id FROM valid")
def st1_old_first_arrivals(spark, sf):
    """Trials that started long before those of earlier batches come through."""
    landing, out, marks = (fresh_path(spark, x) for x in ("landing", "unique", "progress"))
    api = fx.arrays(spark, sf).drop("reject_reason").withColumn("radiant_win", F.col("radiant_win") == 1)
    for k, part in enumerate([api.filter("match_id % 2 = 0"), api.withColumn("start_time", F.col("start_time") - 40 * 86400)]):
        part.coalesce(1).write.json(f"{landing}/{k}")
        unique = st.unique_within(st.accept(st.landing_stream(spark, f"{landing}/*", 1)))
        (unique.select("match_id").writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.schema("match_id long").parquet(out)


@check("st1_watermark_unique", f"WITH {ACCEPTED} SELECT match_id, start_time FROM valid")
def st1_watermark(spark, sf):
    landing, out = landed(spark, sf), fresh_path(spark, "unique")
    unique = st.unique_within(st.accept(st.landing_stream(spark, f"{landing}/*")))
    (unique.select("match_id", "start_time").writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", fresh_path(spark, "progress")).trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.schema("match_id long, start_time long").parquet(out)


def run_stateful(spark, sf) -> tuple[str, str, str]:
    landing, accepted, rejected, progress = (fresh_path(spark, x) for x in ("landing", "accepted", "rejected", "progress"))
    first = landed(spark, sf)
    stateful.stateful_ingest(st.landing_stream(spark, f"{first}/*", 3), accepted, rejected, progress).awaitTermination()
    return accepted, rejected, progress


@check("st1_stateful_ingest", f"""WITH {ACCEPTED}, twice AS (SELECT match_id, CASE WHEN match_id % 97 = 0 THEN 2 ELSE 1 END AS times,
        CASE WHEN len(r) <> 5 OR len(d) <> 5 THEN 'team size' WHEN list_contains(list_concat(r, d), 0) THEN 'missing entity'
            WHEN len(list_distinct(list_concat(r, d))) <> 10 THEN 'repeated entity'
            WHEN duration < 900 THEN 'too short' WHEN avg_rank_tier IS NULL THEN 'no rank' END AS reason FROM listed)
    SELECT match_id, 'accepted' AS outcome, CAST(1 AS BIGINT) AS n FROM valid
    UNION ALL SELECT match_id, 'copy', CAST(1 AS BIGINT) FROM twice WHERE reason IS NULL AND times = 2
    UNION ALL SELECT match_id, reason, CAST(times AS BIGINT) FROM twice WHERE reason IS NOT NULL""")
def st1_stateful(spark, sf):
    accepted, rejected, _ = run_stateful(spark, sf)
    turned_away = spark.read.parquet(rejected).groupBy("match_id", F.col("reject_reason").alias("outcome")).agg(F.sum("copies").alias("n"))
    return spark.read.parquet(accepted).select("match_id", F.lit("accepted").alias("outcome"), F.lit(1).cast("long").alias("n")).unionByName(turned_away)


@check("st1_state_of_ingest", f"WITH {ACCEPTED} SELECT match_id, CAST(CASE WHEN match_id % 97 = 0 THEN 2 ELSE 1 END AS BIGINT) AS times FROM valid")
def st1_state(spark, sf):
    return stateful.seen_trials(spark, run_stateful(spark, sf)[2])


@check("st2_running_rates", f"""
    WITH g AS (SELECT hero_id, COUNT(*) AS games, CAST(SUM(won) AS BIGINT) AS wins FROM facts GROUP BY 1)
    SELECT hero_id, games, wins, round({LO}, 9) AS ci_low, CASE WHEN {LO} > 0.52 THEN 'nerf candidate'
        WHEN {HI} < 0.48 THEN 'buff candidate' ELSE 'within tolerance' END AS action FROM g""")
def st2(spark, sf):
    table, out = run_ingest(spark, sf), fresh_path(spark, "running")
    st.running_rates(spark, table, out, fresh_path(spark, "progress")).awaitTermination()
    return st.latest_rates(spark, out).select("hero_id", "games", "wins", F.round("ci_low", 9).alias("ci_low"), "action")


@check("s3_newest_trials", """
    SELECT match_id FROM trials WHERE match_id < 3000 ORDER BY match_id DESC LIMIT 400""")
def s3(spark, sf):
    return st.newest(settle(fx.trials(spark, sf), "trials"), 400, 3000).select("match_id")


def audited(spark, sf):
    settings = audit.Settings(min_games=fx.MIN_GAMES, min_cell_games=fx.MIN_CELL_GAMES)
    copies = fx.with_copies(fx.arrays(spark, sf))
    return audit.run_audit(audit.prepare_trials(copies), fx.heroes(spark, sf), settings)


@check("audit_balance_report", """
    SELECT (SELECT COUNT(*) FROM trials) AS n_matches, COUNT(*) AS heroes_tested, round(max(win_rate) - min(win_rate), 9) * 100 AS spread_pp,
        COUNT(*) FILTER (p_value < 0.05) AS significant_uncorrected, COUNT(*) FILTER (significant) AS significant_after_bh,
        COUNT(*) FILTER (outside_tolerance) AS outside_tolerance, (SELECT CAST(SUM(radiant_win) AS BIGINT) FROM trials) AS radiant_wins,
        (SELECT round(corr(low, high), 9) FROM pairs) AS correlation
    FROM verdicts""")
def audit_balance(spark, sf):
    report = audited(spark, sf).balance_report
    return report.select(
        "n_matches", "roster.heroes_tested", (F.round(F.col("roster.spread_pp") / 100, 9) * 100).alias("spread_pp"),
        "hero_tests.significant_uncorrected", "hero_tests.significant_after_bh", "hero_tests.outside_tolerance",
        "side_balance.radiant_wins", F.round("bracket_consistency.correlation", 9).alias("correlation"))


@check("audit_sizing_report", f"""
    WITH s AS (SELECT ceil({n_per_group('CAST(0.5 AS DOUBLE)', 'CAST(0.52 AS DOUBLE)')} / pick_rate) AS need,
        ({Z} + {ZB}) * sqrt(0.5 / games) * 100 AS mde, pick_rate, hero_id FROM rates WHERE games >= {fx.MIN_GAMES})
    SELECT COUNT(*) AS entities, CAST(floor(median(need)) AS BIGINT) AS median_matches_needed,
        round(median(mde), 7) AS median_mde_at_current_n_pp,
        (SELECT string_agg(hero_id, ' ' ORDER BY pick_rate DESC, hero_id) FROM (SELECT * FROM s ORDER BY pick_rate DESC, hero_id LIMIT 5)) AS most,
        (SELECT string_agg(hero_id, ' ' ORDER BY pick_rate, hero_id) FROM (SELECT * FROM s ORDER BY pick_rate, hero_id LIMIT 5)) AS least
    FROM s""")
def audit_sizing(spark, sf):
    def ids(column: str):
        return F.array_join(F.transform(column, lambda e: e["hero_id"].cast("string")), " ")

    return audited(spark, sf).sizing_report.select(
        "entities", F.col("median_matches_needed").cast("long").alias("median_matches_needed"),
        F.round("median_mde_at_current_n_pp", 7).alias("median_mde_at_current_n_pp"),
        ids("most_picked").alias("most"), ids("least_picked").alias("least"))


@check("audit_round_trip", "SELECT hero_id, games, wins, action FROM verdicts")
def audit_files(spark, sf):
    path = fresh_path(spark, "audit")
    audit.write_audit(audited(spark, sf), path)
    return readers.read_csv(
        spark, f"{path}/hero_balance",
        "hero_id int, name string, primary_attr string, games long, wins long, win_rate double, pick_rate double, "
        "p_value double, q_value double, significant boolean, ci_low double, ci_high double, outside_tolerance boolean, action string",
    ).select("hero_id", "games", "wins", "action")


@check("followup_report", f"""WITH {SNAPSHOTS}
    SELECT (SELECT COUNT(*) FROM moved) AS n_heroes_compared, (SELECT COUNT(*) FROM beats) AS n_flagged,
        (SELECT COUNT(*) FILTER (actual_dir = predicted_dir) FROM moved WHERE predicted_dir <> 0) AS n_matches_prediction,
        (SELECT COUNT(*) FILTER (residual_beats_null) FROM beats) AS n_beats_null, (SELECT round(b, 8) FROM line) AS null_slope""")
def followup_report(spark, sf):
    from checks.followup_checks import snapshot
    from evenhand.operators import significance as sg
    named = snapshot(spark, sf, 0).join(fx.heroes(spark, sf).select("hero_id", "name"), "hero_id")
    first = settle(sg.with_verdict(sg.with_interval(named), tolerance=0.01), "first")
    live = settle(snapshot(spark, sf, 1).join(fx.heroes(spark, sf).select("hero_id", "name"), "hero_id"), "live")
    report = audit.follow_up(first, live, fx.change_notes(spark, sf))[1]
    return report.select(
        "n_heroes_compared", F.col("direction_test.n").alias("n_flagged"), F.col("direction_test.hits").alias("n_matches_prediction"),
        F.col("null_test.hits").alias("n_beats_null"), F.round("reversion_unflagged.slope", 8).alias("null_slope"))


# --- figure data -------------------------------------------------------------------------------


@check("g1_forest", """
    SELECT hero_id, name, round(ci_low, 9) AS ci_low, CASE WHEN ci_high < 0.48 THEN 'cold' WHEN ci_low > 0.52 THEN 'hot' ELSE 'muted' END AS colour,
        row_number() OVER (ORDER BY win_rate, hero_id) - 1 AS position FROM verdicts""")
def g1(spark, sf):
    return figures.forest(verdict_table(spark, sf)).select(
        "hero_id", "name", F.round("ci_low", 9).alias("ci_low"), "colour", "position")


@check("g2_power_curve", f"""
    WITH e AS (SELECT CAST(point AS INT) AS point, 0.005 + point * (CAST(0.045 AS DOUBLE) / 199) AS effect FROM (SELECT unnest(generate_series(0, 199)) AS point))
    SELECT point, round(effect * 100, 9) AS effect_pp, round({(Z + ZB) ** 2 * 0.5} / (effect * effect), 4) AS hero_games,
        COUNT(*) FILTER (games >= {(Z + ZB) ** 2 * 0.5} / (effect * effect)) AS heroes_with_enough FROM e, rates GROUP BY point, effect""")
def g2(spark, sf):
    return figures.power_curve(fx.rates(spark, sf)).select(
        "point", F.round("effect_pp", 9).alias("effect_pp"), F.round("hero_games", 4).alias("hero_games"), "heroes_with_enough")


@check("g3_low_high_scatter", """
    WITH l AS (SELECT least(min(low), min(high)) - 0.02 AS lo, greatest(max(low), max(high)) + 0.02 AS hi FROM pairs),
    k AS (SELECT hero_id, name FROM pairs ORDER BY abs(delta_pp) DESC, hero_id LIMIT 4)
    SELECT hero_id, round(low, 9) AS low, round(high, 9) AS high, k.name AS label, round(lo, 9) AS axis_low, round(hi, 9) AS axis_high
    FROM pairs LEFT JOIN k USING (hero_id), l""")
def g3(spark, sf):
    pairs = settle(ra.low_high_pairs(stratum_table(spark, sf)), "pairs")
    return figures.low_high_scatter(pairs).select(
        "hero_id", *[F.round(c, 9).alias(c) for c in ("low", "high")], "label",
        *[F.round(c, 9).alias(c) for c in ("axis_low", "axis_high")])


@check("g4_probability_bars")
def g4(spark, sf):
    data = prepared(spark, sf)
    model = logistic.fit(data.train_vectors, 0.01)
    return figures.probability_bars(settle(logistic.predict(model, data.test_vectors, "held_out"), "held_out"))


@check("g5_before_after_scatter", f"""WITH {SNAPSHOTS},
    l AS (SELECT least(min(before_rate), min(after_rate)) - 0.01 AS lo, greatest(max(before_rate), max(after_rate)) + 0.01 AS hi FROM moved)
    SELECT hero_id, action, patch_touched <> 'untouched' AS touched,
        CASE WHEN patch_touched <> 'untouched' THEN name || ' (' || patch_touched || ')' END AS label,
        round(lo, 9) AS axis_low, round(hi, 9) AS axis_high FROM moved, l""")
def g5(spark, sf):
    return figures.before_after_scatter(settle(moved(spark, sf), "moved")).select(
        "hero_id", "action", "touched", "label", *[F.round(c, 9).alias(c) for c in ("axis_low", "axis_high")])


@check("g6_calibration_points", """
    WITH f AS (SELECT * FROM predictions WHERE model = 'half'),
    e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM f),
    b AS (SELECT CAST(len([x for x in edges if x < p]) AS INT) AS bin, COUNT(*) AS n, avg(y) AS t, avg(p) AS q FROM f, e GROUP BY 1)
    SELECT bin, n, round((SELECT least(min(t), min(q)) - 0.03 FROM b), 9) AS axis_low,
        round((SELECT greatest(max(t), max(q)) + 0.03 FROM b), 9) AS axis_high FROM b""")
def g6(spark, sf):
    half = settle(fx.predictions(spark, sf).filter(F.col("model") == "half"), "predictions")
    return figures.calibration_points(half).select("bin", "n", *[F.round(c, 9).alias(c) for c in ("axis_low", "axis_high")])


@check("g6_u3_weight_bars", """
    WITH w AS (SELECT hero_id, CAST(0.24 AS DOUBLE) * (hero_id * 37 % 127 - 63) / CAST(63.0 AS DOUBLE) AS weight FROM ids),
    k AS (SELECT * FROM (SELECT * FROM w ORDER BY weight, hero_id LIMIT 15) UNION ALL SELECT * FROM (SELECT * FROM w ORDER BY weight DESC, hero_id LIMIT 15))
    SELECT k.hero_id, coalesce(name, CAST(k.hero_id AS VARCHAR)) AS name, round(weight, 9) AS weight,
        CASE WHEN weight > 0 THEN 'radiant' ELSE 'dire' END AS favours FROM k LEFT JOIN heroes h USING (hero_id)""")
def g6_bars(spark, sf):
    return figures.weight_bars(fx.weights(spark, sf), fx.heroes(spark, sf)).withColumn("weight", F.round("weight", 9))


@check("g2_detectable_points", f"""
    SELECT name, round(pick_rate * 100, 7) AS pick_rate_pct,
        CAST(ceil({n_per_group('CAST(0.5 AS DOUBLE)', 'CAST(0.52 AS DOUBLE)')} / pick_rate) AS BIGINT) AS matches_needed FROM rates""")
def g2_points(spark, sf):
    return figures.detectable_points(sz.trials_needed(fx.rates(spark, sf))).withColumn("pick_rate_pct", F.round("pick_rate_pct", 7))


@check("native_event_stream", """
    SELECT event_type, COUNT(*) AS games, COUNT(*) FILTER (user_id % 2 = 0) AS wins FROM events GROUP BY 1""")
def native_stream(spark, sf):
    """Counts per event type over the event table read as a stream."""
    source = fx.table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/events*.parquet")
    out = fresh_path(spark, "event_counts")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    counts = ra.count_outcomes(stream.withColumn("hit", (F.col("user_id") % 2 == 0).cast("bigint")), ["event_type"], "hit")
    (counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", fresh_path(spark, "progress"))
     .trigger(availableNow=True).start().awaitTermination())
    return st.latest_rates(spark, out)
