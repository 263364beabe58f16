"""Registered queries of the audit: scans, facts, rates, tests, sizing, follow-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.ctes import Z, ZB, binomial, n_per_group, sql, wilson
from checks.fixtures import MIN_CELL_GAMES, MIN_GAMES
from checks.registry import check
from evenhand.functions.teams import format_team, parse_team
from evenhand.operators import rates as ra
from evenhand.operators import significance as sg
from evenhand.operators import sizing as sz
from evenhand.operators import trials as tr
from evenhand.workspace import settle


def r9(*names: str):
    return [F.round(n, 9).alias(n) for n in names]


# --- projections, filters, integrity -------------------------------------------------------


@check("p1_mode_filter", "SELECT game_mode, COUNT(*) AS n FROM raw_matches WHERE game_mode = 22 GROUP BY 1")
def p1(spark, sf):
    return tr.in_mode(fx.export(spark, sf)).groupBy("game_mode").agg(F.count(F.lit(1)).alias("n"))


@check("p2_reject_reasons", """
    SELECT match_id, CASE WHEN len(r) <> 5 OR len(d) <> 5 THEN 'team size'
        WHEN list_contains(list_concat(r, d), 0) THEN 'missing entity'
        WHEN len(list_distinct(list_concat(r, d))) <> 10 THEN 'repeated entity'
        WHEN duration < 900 THEN 'too short' WHEN avg_rank_tier IS NULL THEN 'no rank' END AS reject_reason
    FROM listed""")
def p2(spark, sf):
    return tr.land_export(fx.export(spark, sf)).select("match_id", "reject_reason")


@check("p3_p4_strata", """
    SELECT match_id, make_timestamp(start_time * 1000000) AS started_at, bracket FROM trials""")
def p3(spark, sf):
    utc = F.to_utc_timestamp("started_at", F.current_timezone()).cast("timestamp_ntz")
    return fx.trials(spark, sf).select("match_id", utc.alias("started_at"), "bracket")


@check("p5_j1_u1_entity_facts", "SELECT match_id, bracket, side, hero_id, won FROM facts")
def p5(spark, sf):
    return fx.facts(spark, sf)


@check("p6_landing_shape", """
    SELECT match_id, radiant_win, array_to_string(r, ' ') AS radiant_team, array_to_string(d, ' ') AS dire_team FROM listed""")
def p6(spark, sf):
    landing = tr.parse_export(fx.export(spark, sf)).withColumn("radiant_win", F.col("radiant_win") == 1)
    return tr.shape_landing(landing).select("match_id", "radiant_win", "radiant_team", "dire_team")


@check("p7_enough_games", "SELECT hero_id, games FROM rates WHERE games >= 800")
def p7(spark, sf):
    return ra.enough_games(fx.rates(spark, sf), 800).select("hero_id", "games")


@check("p8_integrity_failures", """
    SELECT match_id, COUNT(*) AS hero_rows FROM (SELECT match_id FROM facts UNION ALL
        SELECT match_id FROM facts WHERE match_id % 97 = 0) GROUP BY 1 HAVING COUNT(*) <> 10""")
def p8(spark, sf):
    return tr.integrity_failures(fx.with_copies(fx.trials(spark, sf)))


@check("p9_first_per_trial", "SELECT match_id, start_time, radiant_win, radiant_team FROM raw_matches")
def p9(spark, sf):
    later = fx.export(spark, sf).filter(F.col("match_id") % 97 == 0)
    later = later.withColumns({"start_time": F.col("start_time") + 5, "radiant_win": 1 - F.col("radiant_win")})
    copies = fx.with_copies(fx.export(spark, sf)).unionByName(later)
    return tr.first_per_trial(copies).select("match_id", "start_time", "radiant_win", "radiant_team")


@check("f1_f2_team_text", """
    SELECT match_id, array_to_string(r, '-') AS ids, CAST(list_sum(r) AS BIGINT) AS id_sum, radiant_team AS again FROM listed""")
def f1(spark, sf):
    ids = parse_team(F.concat(F.lit("  "), F.regexp_replace("radiant_team", " ", "\t "), F.lit(" ")))
    return fx.export(spark, sf).select(
        "match_id", F.array_join(ids, "-").alias("ids"),
        F.aggregate(ids, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("id_sum"),
        format_team(ids).alias("again"))


@check("f8_array_predicates", """
    SELECT match_id, CAST(len(list_concat(r, d)) AS INT) AS n, CAST(len(list_distinct(list_concat(r, d))) AS INT) AS n_distinct,
        list_contains(list_concat(r, d), 0) AS has_zero FROM listed""")
def f8(spark, sf):
    from evenhand.functions.teams import has_null_or_zero
    both = F.concat("radiant_team", "dire_team")
    return fx.arrays(spark, sf).select(
        "match_id", F.size(both).alias("n"), F.size(F.array_distinct(both)).alias("n_distinct"),
        has_null_or_zero(both).alias("has_zero"))


# --- aggregations --------------------------------------------------------------------------


@check("a1_j2_j7_entity_rates", """
    SELECT hero_id, name, primary_attr, games, wins, round(win_rate, 9) AS win_rate, round(pick_rate, 9) AS pick_rate FROM rates""")
def a1(spark, sf):
    return fx.rates(spark, sf).select("hero_id", "name", "primary_attr", "games", "wins", *r9("win_rate", "pick_rate"))


def stratum_table(spark, sf):
    cells = settle(ra.count_outcomes(fx.facts(spark, sf), ["bracket", "hero_id"]), "cells")
    return ra.stratum_rates(cells, fx.heroes(spark, sf), min_games=MIN_CELL_GAMES)


@check("a2_stratum_rates", "SELECT bracket, hero_id, name, games, wins, round(win_rate, 9) AS win_rate FROM stratum_rates")
def a2(spark, sf):
    return stratum_table(spark, sf).select("bracket", "hero_id", "name", "games", "wins", *r9("win_rate"))


@check("a19_rolled_up_rates", """
    SELECT hero_id, COUNT(*) AS games, CAST(SUM(won) AS BIGINT) AS wins FROM facts GROUP BY 1""")
def a19(spark, sf):
    return ra.roll_up(ra.count_outcomes(fx.facts(spark, sf), ["bracket", "hero_id"]), ["hero_id"])


@check("a3_side_balance", """
    SELECT COUNT(*) AS matches, CAST(SUM(radiant_win) AS BIGINT) AS radiant_wins,
        round(SUM(radiant_win) / CAST(COUNT(*) AS DOUBLE), 9) AS radiant_win_rate FROM trials""")
def a3(spark, sf):
    return ra.side_balance(fx.trials(spark, sf)).select("matches", "radiant_wins", *r9("radiant_win_rate"))


@check("a4_side_balance_by_stratum", """
    SELECT bracket, COUNT(*) AS matches, CAST(SUM(radiant_win) AS BIGINT) AS radiant_wins,
        round(SUM(radiant_win) / CAST(COUNT(*) AS DOUBLE), 9) AS radiant_win_rate FROM trials GROUP BY 1""")
def a4(spark, sf):
    return ra.side_balance(fx.trials(spark, sf), ["bracket"]).select(
        "bracket", "matches", "radiant_wins", *r9("radiant_win_rate"))


@check("a5_roster_spread", f"""
    SELECT COUNT(*) AS heroes, round(MIN(win_rate), 9) AS min_win_rate, round(MAX(win_rate), 9) AS max_win_rate,
        round(MAX(win_rate) - MIN(win_rate), 9) AS spread, round(STDDEV_SAMP(win_rate), 9) AS sd
    FROM rates WHERE games >= {MIN_GAMES}""")
def a5(spark, sf):
    return ra.roster_spread(fx.rates(spark, sf), MIN_GAMES).select(
        "heroes", *r9("min_win_rate", "max_win_rate", "spread", "sd"))


@check("a6_usable_strata", "SELECT bracket, entities FROM usable")
def a6(spark, sf):
    return ra.usable_strata(stratum_table(spark, sf))


@check("j8_low_high_pairs", """
    SELECT hero_id, name, low_bracket, high_bracket, round(low, 9) AS low, round(high, 9) AS high,
        round(delta_pp, 7) AS delta_pp FROM pairs""")
def j8(spark, sf):
    return ra.low_high_pairs(stratum_table(spark, sf)).select(
        "hero_id", "name", "low_bracket", "high_bracket", *r9("low", "high"), F.round("delta_pp", 7).alias("delta_pp"))


# p-value of a correlation by the finite series for integer degrees of freedom: an independent
# route to the same number.
T_TEST_P = """(SELECT CASE WHEN df % 2 = 0 THEN
      1 - sin(th) * (1 + coalesce((SELECT sum(exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0) + 2 * k * ln(cos(th))))
            FROM unnest(generate_series(1, CAST(df / 2 - 1 AS BIGINT))) AS g(k)), 0))
    ELSE 1 - 2 / pi() * (th + sin(th) * coalesce((SELECT sum(exp(lgamma(k + 1.0) + lgamma(0.5) - lgamma(k + 0.5)
            - ln(2.0) + (2 * k - 1) * ln(cos(th)) - ln(k)))
            FROM unnest(generate_series(1, CAST((df - 1) / 2 AS BIGINT))) AS g(k)), 0)) END
    FROM (SELECT n - 2 AS df, asin(least(1.0, abs(r))) AS th))"""


@check("a7_t6_stratum_correlation", f"""
    SELECT n, round(r, 9) AS correlation, round({T_TEST_P}, 8) AS p_value
    FROM (SELECT COUNT(*) AS n, corr(low, high) AS r FROM pairs)""")
def a7(spark, sf):
    return sg.correlate(ra.low_high_pairs(stratum_table(spark, sf)), "low", "high").select(
        "n", *r9("correlation"), F.round("p_value", 8).alias("p_value"))


@check("t7_stratum_consistency", """
    SELECT (SELECT array_to_string(list_sort(list(bracket)), ' ') FROM usable) AS brackets_compared,
        min(low_bracket) AS low_bracket, max(high_bracket) AS high_bracket, COUNT(*) AS n_heroes,
        round(corr(low, high), 9) AS correlation,
        (SELECT string_agg(hero_id, ' ' ORDER BY abs(delta_pp) DESC, hero_id) FROM
            (SELECT * FROM pairs ORDER BY abs(delta_pp) DESC, hero_id LIMIT 5)) AS worst
    FROM pairs""")
def t7(spark, sf):
    return sg.stratum_consistency(stratum_table(spark, sf)).select(
        F.array_join("brackets_compared", " ").alias("brackets_compared"), "low_bracket", "high_bracket", "n_heroes",
        *r9("correlation"),
        F.array_join(F.transform("biggest_divergence", lambda e: e["hero_id"].cast("string")), " ").alias("worst"))


# --- tests ---------------------------------------------------------------------------------


@check("t1_wilson_interval", f"""
    SELECT hero_id, round({wilson('wins', 'games')[0]}, 9) AS ci_low, round({wilson('wins', 'games')[1]}, 9) AS ci_high FROM rates""")
def t1(spark, sf):
    return sg.with_interval(fx.rates(spark, sf)).select("hero_id", *r9("ci_low", "ci_high"))


@check("t2_binomial", "SELECT hero_id, round(p_value, 9) AS p_value FROM tests")
def t2(spark, sf):
    return sg.with_binomial(ra.enough_games(fx.rates(spark, sf), MIN_GAMES)).select("hero_id", *r9("p_value"))


@check("t3_false_discovery", "SELECT hero_id, round(q_value, 8) AS q_value, q_value <= 0.05 AS significant FROM corrected")
def t3(spark, sf):
    tested = sg.with_binomial(ra.enough_games(fx.rates(spark, sf), MIN_GAMES))
    return sg.adjust_false_discovery(tested).select("hero_id", F.round("q_value", 8).alias("q_value"), "significant")


@check("t3_false_discovery_by_stratum", f"""
    WITH p AS (SELECT bracket, hero_id, {binomial('wins', 'games')} AS p_value FROM stratum_rates),
    k AS (SELECT *, count(*) OVER (PARTITION BY bracket ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rnk,
        count(*) OVER (PARTITION BY bracket) AS m FROM p)
    SELECT bracket, hero_id, round(least(1.0, min(p_value * m / rnk) OVER (PARTITION BY bracket ORDER BY p_value DESC
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) + 1e-11, 8) AS q_value FROM k""")
def t3_family(spark, sf):
    tested = sg.with_binomial(stratum_table(spark, sf))
    return sg.adjust_false_discovery(tested, family=["bracket"], rows_per_range=200).select(
        # Small samples give p-values that are exact binary fractions; this keeps them off rounding ties.
        "bracket", "hero_id", F.round(F.col("q_value") + 1e-11, 8).alias("q_value"))


def verdict_table(spark, sf):
    return sg.audit_entities(fx.rates(spark, sf), MIN_GAMES)


@check("t4_f5_verdicts", """
    SELECT hero_id, name, games, wins, round(p_value, 9) AS p_value, round(q_value, 8) AS q_value, significant,
        round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, outside_tolerance, action FROM verdicts""")
def t4(spark, sf):
    return verdict_table(spark, sf).select(
        "hero_id", "name", "games", "wins", *r9("p_value"), F.round("q_value", 8).alias("q_value"), "significant",
        *r9("ci_low", "ci_high"), "outside_tolerance", "action")


@check("t5_side_test", f"""
    SELECT matches, radiant_wins, round(radiant_wins / CAST(matches AS DOUBLE), 9) AS radiant_win_rate,
        round({binomial('radiant_wins', 'matches')}, 9) AS p_value,
        round({wilson('radiant_wins', 'matches')[0]}, 9) AS ci_low, round({wilson('radiant_wins', 'matches')[1]}, 9) AS ci_high,
        round((radiant_wins / CAST(matches AS DOUBLE) - 0.5) * 100, 7) AS advantage_pp
    FROM (SELECT COUNT(*) AS matches, CAST(SUM(radiant_win) AS BIGINT) AS radiant_wins FROM trials)""")
def t5(spark, sf):
    return sg.audit_sides(ra.side_balance(fx.trials(spark, sf))).select(
        "matches", "radiant_wins", *r9("radiant_win_rate", "p_value", "ci_low", "ci_high"),
        F.round("advantage_pp", 7).alias("advantage_pp"))


@check("a15_verdict_summary", """
    SELECT COUNT(*) AS heroes_tested, COUNT(*) FILTER (p_value < 0.05) AS significant_uncorrected,
        round(0.05 * CAST(COUNT(*) AS DOUBLE), 9) AS expected_false_positives,
        COUNT(*) FILTER (significant) AS significant_after_bh, COUNT(*) FILTER (outside_tolerance) AS outside_tolerance,
        coalesce(string_agg(name, ',' ORDER BY win_rate, hero_id) FILTER (action = 'nerf candidate'), '') AS nerf_candidates,
        coalesce(string_agg(name, ',' ORDER BY win_rate, hero_id) FILTER (action = 'buff candidate'), '') AS buff_candidates
    FROM verdicts""")
def a15(spark, sf):
    return sg.verdict_summary(verdict_table(spark, sf)).select(
        "heroes_tested", "significant_uncorrected", *r9("expected_false_positives"), "significant_after_bh",
        "outside_tolerance", F.array_join("nerf_candidates", ",").alias("nerf_candidates"),
        F.array_join("buff_candidates", ",").alias("buff_candidates"))


# --- top-k ---------------------------------------------------------------------------------


@check("k1_sorted_rates", "SELECT hero_id, CAST(row_number() OVER (ORDER BY win_rate DESC, hero_id) AS INT) AS place FROM rates")
def k1(spark, sf):
    from evenhand.operators.ranking import with_global_index
    ordered = fx.rates(spark, sf).select("hero_id", F.struct(-F.col("win_rate"), "hero_id").alias("sort_key"))
    return with_global_index(ordered, "sort_key").select("hero_id", (F.col("row_index") + 1).cast("int").alias("place"))


@check("k2_pick_rate_extremes", """
    SELECT 'most' AS "end", hero_id, games FROM (SELECT * FROM rates ORDER BY pick_rate DESC, hero_id LIMIT 5)
    UNION ALL SELECT 'least', hero_id, games FROM (SELECT * FROM rates ORDER BY pick_rate, hero_id LIMIT 5)""")
def k2(spark, sf):
    return ra.extremes(fx.rates(spark, sf), "pick_rate", 5).select("end", "hero_id", "games")


@check("k3_top_divergence", """
    SELECT hero_id, round(delta_pp, 7) AS delta_pp FROM pairs ORDER BY abs(delta_pp) DESC, hero_id LIMIT 4""")
def k3(spark, sf):
    return ra.top_divergence(ra.low_high_pairs(stratum_table(spark, sf)), 4).select(
        "hero_id", F.round("delta_pp", 7).alias("delta_pp"))


@check("k4_rate_extremes", """
    SELECT 'most' AS "end", hero_id, name FROM (SELECT * FROM rates ORDER BY win_rate DESC, hero_id LIMIT 3)
    UNION ALL SELECT 'least', hero_id, name FROM (SELECT * FROM rates ORDER BY win_rate, hero_id LIMIT 3)""")
def k4(spark, sf):
    return ra.extremes(fx.rates(spark, sf), "win_rate", 3).select("end", "hero_id", "name")


# --- sizing --------------------------------------------------------------------------------


@check("t8_f4_games_needed", f"""
    SELECT hero_id, round({n_per_group('win_rate', '(win_rate + 0.02)')}, 3) AS games_needed FROM rates""")
def t8(spark, sf):
    rates = fx.rates(spark, sf)
    return sz.with_games_needed(rates, F.col("win_rate"), F.col("win_rate") + 0.02).select(
        "hero_id", F.round("games_needed", 3).alias("games_needed"))


@check("t9_detectable_effect", f"""
    SELECT hero_id, round(({Z} + {ZB}) * sqrt(0.5 / games), 9) AS mde FROM rates""")
def t9(spark, sf):
    return sz.with_detectable_effect(fx.rates(spark, sf)).select("hero_id", *r9("mde"))


@check("t10_effect_table", f"""
    SELECT round(effect * 100, 6) AS effect_pp, CAST(ceil(n) AS BIGINT) AS hero_games_per_period,
        COUNT(*) FILTER (games >= ceil(n)) AS heroes_with_enough
    FROM (SELECT games, effect, {n_per_group('CAST(0.5 AS DOUBLE)', '(0.5 + effect)')} AS n FROM rates,
        (SELECT CAST(unnest([0.005, 0.01, 0.02, 0.03, 0.05]) AS DOUBLE) AS effect)) GROUP BY 1, 2""")
def t10(spark, sf):
    return sz.effect_table(fx.rates(spark, sf)).withColumn("effect_pp", F.round("effect_pp", 6))


@check("t11_trials_needed", f"""
    SELECT hero_id, CAST(ceil({n_per_group('CAST(0.5 AS DOUBLE)', 'CAST(0.52 AS DOUBLE)')} / pick_rate) AS BIGINT) AS matches_needed,
        round(({Z} + {ZB}) * sqrt(0.5 / games) * 100, 7) AS mde_at_current_n FROM rates""")
def t11(spark, sf):
    return sz.trials_needed(fx.rates(spark, sf)).select(
        "hero_id", "matches_needed", F.round("mde_at_current_n", 7).alias("mde_at_current_n"))


@check("t12_change_plan", f"""
    WITH g AS (SELECT * FROM (VALUES (CAST(1.0 AS DOUBLE)), (2.0), (5.0)) AS e(effect_pp),
        (VALUES (CAST(0.8 AS DOUBLE), CAST({ZB} AS DOUBLE)), (0.9, 1.2815515655446004)) AS w(power, zb)),
    n AS (SELECT *, CAST(ceil({n_per_group('CAST(0.5 AS DOUBLE)', '(0.5 + effect_pp / 100)', str(Z), 'zb')}) AS BIGINT) AS need FROM rates, g)
    SELECT hero_id, effect_pp, power, CASE WHEN games >= 800 THEN need END AS hero_games,
        CASE WHEN games >= 800 THEN CAST(ceil(need / pick_rate) AS BIGINT) END AS matches,
        CASE WHEN games >= 800 THEN round(({Z} + zb) * sqrt(0.5 / games) * 100, 7) END AS current_mde_pp,
        CASE WHEN games >= 800 THEN greatest(need - games, 0) END AS shortfall,
        CASE WHEN games < 800 THEN 'no data' WHEN games >= need THEN 'enough' ELSE 'short' END AS status FROM n""")
def t12(spark, sf):
    plan = sz.plan_changes(fx.rates(spark, sf), [1, 2, 5], [0.8, 0.9], min_games=800)
    return plan.select(
        "hero_id", "effect_pp", "power", "hero_games", "matches", F.round("current_mde_pp", 7).alias("current_mde_pp"),
        F.when(F.col("status") != "no data", F.col("shortfall")).alias("shortfall"), "status")
