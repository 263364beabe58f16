"""The whole audit as one job: counts once, then tables and nested reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.operators import followup as fu
from evenhand.operators import rates as ra
from evenhand.operators import significance as sg
from evenhand.operators import sizing as sz
from evenhand.operators import trials as tr
from evenhand.sources.sinks import write_report, write_table
from evenhand.workspace import concurrently, settle


@dataclass
class Settings:
    min_games: int = 500
    min_cell_games: int = 100
    min_entities: int = 60
    tolerance: float = 0.02
    alpha: float = 0.05
    power: float = 0.8
    target_effect: float = 0.02


@dataclass
class Audit:
    """Stored results, each small: at most one row per entity and stratum."""

    rates: DataFrame
    by_stratum: DataFrame
    sides_by_stratum: DataFrame
    tests: DataFrame
    sized: DataFrame
    balance_report: DataFrame
    sizing_report: DataFrame


def prepare_trials(export: DataFrame, mode: int | None = 22) -> DataFrame:
    """Landed export rows (`land_export`) to the audited trials: one mode, valid, each id once, stored."""
    return settle(tr.with_strata(tr.first_per_trial(tr.valid_trials(tr.in_mode(export, mode)))), "trials")


def run_audit(trials: DataFrame, dimension: DataFrame, settings: Settings = Settings(), check: bool = True) -> Audit:
    """Every table of the audit from stored trials.

    The trials are read three times, each time with few columns: for the integrity gate, for the
    counts per (stratum, entity), and for the sides per stratum. Everything else rolls up from
    those counts.
    """
    spark = trials.sparkSession
    _, cells, sides = concurrently(spark, [
        lambda: tr.assert_integrity(trials) if check else None,
        lambda: settle(ra.count_outcomes(tr.entity_facts(trials), ["bracket", "hero_id"]), "cells"),
        lambda: settle(ra.side_balance(trials, ["bracket"]), "sides"),
    ])
    side_total = sides.agg(F.sum("matches").alias("matches"), F.sum("radiant_wins").alias("radiant_wins"))
    side_total = side_total.withColumn("radiant_win_rate", ra.rate("radiant_wins", "matches"))

    rates, by_stratum = concurrently(spark, [
        lambda: settle(ra.entity_rates(ra.roll_up(cells, ["hero_id"]), dimension, trials), "rates"),
        lambda: settle(ra.stratum_rates(cells, dimension, min_games=settings.min_cell_games), "strata"),
    ])
    tests, sized = concurrently(spark, [
        lambda: settle(sg.audit_entities(rates, settings.min_games, settings.tolerance, settings.alpha), "verdicts"),
        lambda: settle(sz.trials_needed(
            ra.enough_games(rates, settings.min_games), settings.target_effect, settings.alpha, settings.power), "sized"),
    ])

    def one(df: DataFrame):
        return df.select(F.struct("*")).scalar()

    roster = ra.roster_spread(rates, settings.min_games).select(
        F.col("heroes").alias("heroes_tested"), "min_win_rate", "max_win_rate",
        (F.col("spread") * 100).alias("spread_pp"), (F.col("sd") * 100).alias("sd_pp"))
    balance_report = side_total.select(
        F.col("matches").alias("n_matches"),
        F.lit(settings.min_games).alias("min_games_threshold"),
        F.lit(settings.tolerance * 100).alias("tolerance_pp"),
        F.lit(settings.alpha).alias("alpha"),
        one(roster).alias("roster"),
        one(sg.verdict_summary(tests, settings.alpha)).alias("hero_tests"),
        one(sg.audit_sides(side_total, settings.alpha)).alias("side_balance"),
        one(sg.stratum_consistency(by_stratum, min_entities=settings.min_entities)).alias("bracket_consistency"),
    )
    return Audit(rates, by_stratum, sides, tests, sized, balance_report, sizing_report(rates, sized, settings))


def sizing_report(rates: DataFrame, sized: DataFrame, settings: Settings, k: int = 5) -> DataFrame:
    """One row: effect table, medians, and the most and least picked entities."""
    from evenhand.operators.ranking import exact_quantiles

    (median_trials,) = exact_quantiles(sized, "matches_needed", [0.5])
    (median_effect,) = exact_quantiles(sized, "mde_at_current_n", [0.5])
    columns = ("name", "pick_rate", "games", "matches_needed", "mde_at_current_n")
    ends = ra.extremes(sized, "pick_rate", k)

    def end(label: str, sign: int):
        chosen = ends.filter(F.col("end") == label).agg(
            F.sort_array(F.collect_list(F.struct((sign * F.col("pick_rate")).alias("_order"), "hero_id", *columns))).alias("e"))
        return chosen.scalar()

    table = sz.effect_table(ra.enough_games(rates, settings.min_games), alpha=settings.alpha, power=settings.power)
    effects = table.agg(F.sort_array(F.collect_list(F.struct("effect_pp", "hero_games_per_period"))).alias("t")).scalar()
    return sized.agg(
        F.lit(settings.alpha).alias("alpha"), F.lit(settings.power).alias("power"),
        F.lit(settings.target_effect * 100).alias("target_effect_pp"),
        F.lit(int(median_trials) if median_trials == median_trials else None).alias("median_matches_needed"),
        F.lit(median_effect).alias("median_mde_at_current_n_pp"),
        F.count(F.lit(1)).alias("entities"),
    ).withColumns({"sample_size_table": effects, "most_picked": end("most", -1), "least_picked": end("least", 1)})


def write_audit(audit: Audit, path: str) -> None:
    """Entity tables as CSV, strata as Parquet, reports as JSON."""
    write_table(audit.tests, f"{path}/hero_balance", "csv")
    write_table(audit.sized, f"{path}/hero_power", "csv")
    write_table(audit.by_stratum, f"{path}/strata")
    write_report(audit.balance_report, f"{path}/balance")
    write_report(audit.sizing_report, f"{path}/power")


def follow_up(audited: DataFrame, live: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Movement per entity and a one-row report: hits, residual hits, both reversion lines, controls."""
    fu.assert_complete(audited, live)
    merged = fu.merge_snapshots(audited, live)
    moved = settle(fu.with_movement(fu.with_change_notes(merged, notes)), "moved")

    def one(df: DataFrame):
        return df.select(F.struct("*")).scalar()

    report = moved.agg(F.count(F.lit(1)).alias("n_heroes_compared")).withColumns({
        "direction_test": one(fu.hit_test(fu.flagged(moved), "matches_prediction")),
        "null_test": one(fu.hit_test(fu.null_residuals(moved), "residual_beats_null")),
        "reversion_all": one(fu.reversion(moved)),
        "reversion_unflagged": one(fu.reversion(moved.filter(F.col("action") == sg.WITHIN))),
        "controls": one(fu.control_counts(moved)),
    })
    return moved, report
