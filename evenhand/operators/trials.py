"""Trial-level operators: validity, shaping, filters, deduplication, line-ups to rows.

A trial has two sides, each with a list of entities, and a 0/1 outcome seen from side A. Default
column names are those of the match export; every function takes its columns as arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.teams import all_distinct, format_team, has_null_or_zero, parse_team
from evenhand.workspace import settle, spread

SIDE_A, SIDE_B = "radiant", "dire"


def reject_reason(
    team_a: str = "radiant_team",
    team_b: str = "dire_team",
    duration: str = "duration",
    rank: str = "avg_rank_tier",
    team_size: int = 5,
    min_duration: int = 900,
) -> Column:
    """Why a trial is unusable, or null if it is valid. The first failing rule is named."""
    a, b = F.col(team_a), F.col(team_b)
    both = F.concat(a, b)
    return (
        F.when(a.isNull() | b.isNull(), "missing team")
        .when((F.size(a) != team_size) | (F.size(b) != team_size), "team size")
        .when(has_null_or_zero(both), "missing entity")
        .when(~all_distinct(both), "repeated entity")
        .when(F.coalesce(F.col(duration), F.lit(0)) < min_duration, "too short")
        .when(F.col(rank).isNull(), "no rank")
    )


def with_reject_reason(trials: DataFrame, **rules) -> DataFrame:
    return trials.withColumn("reject_reason", reject_reason(**rules))


def valid_trials(trials: DataFrame, **rules) -> DataFrame:
    """Only trials that pass every rule of `reject_reason`; a stored reason is used as it is."""
    if "reject_reason" in trials.columns:
        return trials.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return trials.filter(reject_reason(**rules).isNull())


def parse_export(export: DataFrame, teams: tuple[str, str] = ("radiant_team", "dire_team")) -> DataFrame:
    """Team text columns to integer arrays."""
    return export.withColumns({t: parse_team(t) for t in teams})


def land_export(export: DataFrame, teams: tuple[str, str] = ("radiant_team", "dire_team"), **rules) -> DataFrame:
    """Export rows as a stored Parquet table with team arrays and `reject_reason`.

    Parsing and checking run once per row here. Filtering unparsed rows directly would make the
    optimizer repeat the parsing inside the filter; on the stored table the mode and the reason
    are plain column filters that reach the scan.
    """
    return settle(with_reject_reason(parse_export(spread(export), teams), **rules), "landed")


def shape_landing(landing: DataFrame) -> DataFrame:
    """API objects to export rows: boolean outcome to 0/1, team lists to text."""
    return landing.select(
        "match_id", "start_time", "duration", "lobby_type", "game_mode", "avg_rank_tier",
        F.coalesce(F.col("radiant_win"), F.lit(False)).cast("int").alias("radiant_win"),
        format_team("radiant_team").alias("radiant_team"),
        format_team("dire_team").alias("dire_team"),
    )


def in_mode(trials: DataFrame, mode: int | None = 22, column: str = "game_mode") -> DataFrame:
    """Keep one game mode; `None` keeps all."""
    return trials if mode is None else trials.filter(F.col(column) == mode)


def with_strata(trials: DataFrame, rank: str = "avg_rank_tier", epoch: str = "start_time") -> DataFrame:
    """Add `started_at` from epoch seconds and the stratum `bracket`, the tens digit of the rank."""
    return trials.withColumns({
        "started_at": F.timestamp_seconds(F.col(epoch)),
        "bracket": F.expr(f"{rank} div 10"),
    })


def first_per_trial(
    trials: DataFrame, trial: str = "match_id", order: tuple[str, ...] = ("start_time",)
) -> DataFrame:
    """One row per trial id: the first by `order`, then by all other columns, so it is repeatable.

    Spark limits each map task to one row per key before the shuffle (WindowGroupLimit), so a
    trial id copied very often costs one row per task.
    """
    rest = [c for c in trials.columns if c not in (trial, *order)]
    first = Window.partitionBy(trial).orderBy(*order, *rest)
    return (
        trials.withColumn("_copy", F.row_number().over(first)).filter(F.col("_copy") == 1).drop("_copy")
    )


def entity_facts(
    trials: DataFrame,
    keep: tuple[str, ...] = ("match_id", "bracket"),
    team_a: str = "radiant_team",
    team_b: str = "dire_team",
    won_a: str = "radiant_win",
    entity: str = "hero_id",
) -> DataFrame:
    """One row per (trial, entity) with its side and the outcome seen from that side.

    Both sides come out of one scan; nothing is shuffled.
    """
    sides = F.array(
        F.struct(F.lit(SIDE_A).alias("side"), F.col(team_a).alias("team"), F.col(won_a).alias("won")),
        F.struct(F.lit(SIDE_B).alias("side"), F.col(team_b).alias("team"), (1 - F.col(won_a)).alias("won")),
    )
    return (
        trials.select(*keep, F.inline(sides))
        .select(*keep, "side", F.explode("team").alias(entity), "won")
    )


def integrity_failures(
    trials: DataFrame,
    trial: str = "match_id",
    team_a: str = "radiant_team",
    team_b: str = "dire_team",
    rows_per_trial: int = 10,
) -> DataFrame:
    """Trial ids that do not give exactly `rows_per_trial` fact rows (bad line-ups or copies).

    Counts array sizes instead of unpivoted rows, so it shuffles one partial sum per trial id.
    """
    rows = F.coalesce(F.size(team_a), F.lit(0)) + F.coalesce(F.size(team_b), F.lit(0))
    return (
        trials.groupBy(trial).agg(F.sum(rows).alias("hero_rows"))
        .filter((F.col("hero_rows") != rows_per_trial) & (F.col("hero_rows") > 0))
    )


def assert_integrity(trials: DataFrame, **columns) -> None:
    """Raise if any trial fails `integrity_failures`."""
    bad = integrity_failures(trials, **columns).limit(5).collect()
    if bad:
        raise ValueError(f"trials with a wrong number of fact rows, for example {bad}")
