"""Experiment sizing: games and trials needed to confirm a change, and smallest visible change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.proportions import detectable_effect, games_per_group, normal_quantile


def _z(alpha: float, power: float) -> tuple[Column, Column]:
    return F.lit(normal_quantile(1 - alpha / 2)), F.lit(normal_quantile(power))


def with_games_needed(
    df: DataFrame, p1: Column, p2: Column, alpha: float = 0.05, power: float = 0.8,
    name: str = "games_needed",
) -> DataFrame:
    """Unrounded games per period to tell rate `p2` from `p1`."""
    return df.withColumn(name, games_per_group(p1, p2, *_z(alpha, power)))


def with_detectable_effect(
    df: DataFrame, games: str = "games", p1: float = 0.5, alpha: float = 0.05, power: float = 0.8,
    name: str = "mde",
) -> DataFrame:
    return df.withColumn(name, detectable_effect(F.col(games), F.lit(p1), *_z(alpha, power)))


def with_effects(df: DataFrame, effects: Sequence[float], name: str = "effect") -> DataFrame:
    """Repeat each row once per effect size of a fixed list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(e) for e in effects])))


def effect_table(
    rates: DataFrame,
    effects: Sequence[float] = (0.005, 0.01, 0.02, 0.03, 0.05),
    alpha: float = 0.05,
    power: float = 0.8,
) -> DataFrame:
    """Games per period for each effect, and how many entities of `rates` already have them.

    Every effect has its row, also if `rates` is empty.
    """
    spark = rates.sparkSession
    listed = spark.createDataFrame([(float(e),) for e in effects], "effect double")
    needs = with_games_needed(listed, F.lit(0.5), 0.5 + F.col("effect"), alpha, power)
    needs = needs.select((F.col("effect") * 100).alias("effect_pp"), F.ceil("games_needed").alias("hero_games_per_period"))
    sized = with_games_needed(
        with_effects(rates.select("games"), effects), F.lit(0.5), 0.5 + F.col("effect"), alpha, power
    )
    enough = (
        sized.groupBy((F.col("effect") * 100).alias("effect_pp"))
        .agg(F.count_if(F.col("games") >= F.ceil("games_needed")).alias("heroes_with_enough"))
    )
    return needs.join(enough, "effect_pp", "left").fillna(0, ["heroes_with_enough"])


def trials_needed(
    rates: DataFrame, effect: float = 0.02, alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Per entity: trials the population must play, ceil(n / pick rate) with n not rounded, and
    the effect in percentage points that the present games can show."""
    sized = with_games_needed(rates, F.lit(0.5), F.lit(0.5 + effect), alpha, power, "_n")
    shown = with_detectable_effect(sized, alpha=alpha, power=power, name="_mde")
    return (
        shown.withColumn("matches_needed", F.ceil(F.col("_n") / F.col("pick_rate")))
        .withColumn("mde_at_current_n", F.col("_mde") * 100)
        .drop("_n", "_mde")
    )


def plan_changes(
    rates: DataFrame,
    effects_pp: Sequence[float],
    powers: Sequence[float] = (0.8,),
    alphas: Sequence[float] = (0.05,),
    min_games: int = 500,
) -> DataFrame:
    """A plan per entity and setting of a fixed grid; z-values are looked up once per setting.

    Games are rounded up before the division by the pick rate, unlike in `trials_needed`. Entities
    below `min_games` get the status `no data` and no numbers.
    """
    grid = F.array(*[
        F.struct(
            F.lit(float(e)).alias("effect_pp"), F.lit(float(w)).alias("power"), F.lit(float(a)).alias("alpha"),
            F.lit(normal_quantile(1 - a / 2)).alias("z_a"), F.lit(normal_quantile(w)).alias("z_b"),
        )
        for e in effects_pp for w in powers for a in alphas
    ])
    plan = rates.select("*", F.inline(grid))
    p2 = 0.5 + F.col("effect_pp") / 100
    known = F.col("games") >= min_games

    def if_known(value: Column) -> Column:
        return F.when(known, value)

    return (
        plan
        .withColumn("hero_games", if_known(F.ceil(games_per_group(F.lit(0.5), p2, F.col("z_a"), F.col("z_b")))))
        .withColumn("matches", F.ceil(F.col("hero_games") / F.col("pick_rate")))
        .withColumn("current_mde_pp", if_known(
            detectable_effect(F.col("games"), F.lit(0.5), F.col("z_a"), F.col("z_b")) * 100))
        .withColumn("already_enough", F.col("games") >= F.col("hero_games"))
        .withColumn("shortfall", F.greatest(F.col("hero_games") - F.col("games"), F.lit(0)))
        .withColumn("status", F.when(~known, "no data").when(F.col("already_enough"), "enough").otherwise("short"))
        .drop("z_a", "z_b")
    )
