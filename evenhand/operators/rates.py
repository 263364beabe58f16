"""Success rates of entities and sides.

Rates aggregate first and join the dimension afterwards, so only one row per entity (and stratum)
is joined. Counts combine map-side; a hot entity costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(wins: str = "wins", games: str = "games") -> Column:
    return F.col(wins) / F.col(games)


def count_outcomes(facts: DataFrame, by: Sequence[str], won: str = "won") -> DataFrame:
    """Games and wins per group: the base table that all rates roll up from."""
    return facts.groupBy(*by).agg(F.count(F.lit(1)).alias("games"), F.sum(won).alias("wins"))


def roll_up(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coarser counts from finer ones, without going back to the facts."""
    return cells.groupBy(*by).agg(F.sum("games").alias("games"), F.sum("wins").alias("wins"))


def entity_rates(
    counts: DataFrame,
    dimension: DataFrame,
    trials: DataFrame,
    entity: str = "hero_id",
    attributes: Sequence[str] = ("name", "primary_attr"),
) -> DataFrame:
    """Win rate and pick rate per entity from its `games` and `wins`.

    The pick rate divides by the number of trials, not of fact rows. Entities missing from the
    dimension are dropped, as by an inner join of the facts. The dimension is not hinted: the
    planner broadcasts it when its size allows.
    """
    total = trials.select(F.count(F.lit(1))).scalar()
    return (
        counts.join(dimension.select(entity, *attributes), entity)
        .select(entity, *attributes, "games", "wins", rate().alias("win_rate"),
                (F.col("games") / total).alias("pick_rate"))
    )


def stratum_rates(
    cells: DataFrame,
    dimension: DataFrame,
    entity: str = "hero_id",
    strata: Sequence[str] = ("bracket",),
    min_games: int = 100,
) -> DataFrame:
    """Win rate per entity and stratum, for cells with at least `min_games`."""
    return (
        cells.filter(F.col("games") >= min_games)
        .join(dimension.select(entity, "name"), entity)
        .select(*strata, entity, "name", "games", "wins", rate().alias("win_rate"))
    )


def side_balance(trials: DataFrame, by: Sequence[str] = (), won_a: str = "radiant_win") -> DataFrame:
    """Trials, side-A wins and side-A rate, overall or per stratum."""
    counted = trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matches"), F.sum(won_a).alias("radiant_wins")
    )
    return counted.withColumn("radiant_win_rate", rate("radiant_wins", "matches"))


def enough_games(rates: DataFrame, min_games: int = 500) -> DataFrame:
    return rates.filter(F.col("games") >= min_games)


def roster_spread(rates: DataFrame, min_games: int = 500) -> DataFrame:
    """How far the entity rates lie apart: count, extremes, range, sample deviation."""
    return enough_games(rates, min_games).agg(
        F.count(F.lit(1)).alias("heroes"),
        F.min("win_rate").alias("min_win_rate"),
        F.max("win_rate").alias("max_win_rate"),
        (F.max("win_rate") - F.min("win_rate")).alias("spread"),
        F.stddev_samp("win_rate").alias("sd"),
    )


def usable_strata(by_stratum: DataFrame, stratum: str = "bracket", min_entities: int = 60) -> DataFrame:
    """Strata in which at least `min_entities` entities have a rate."""
    return (
        by_stratum.groupBy(stratum).agg(F.count(F.lit(1)).alias("entities"))
        .filter(F.col("entities") >= min_entities)
    )


def low_high_pairs(
    by_stratum: DataFrame, entity: str = "hero_id", stratum: str = "bracket", min_entities: int = 60
) -> DataFrame:
    """Rates of each entity in the lowest and in the highest usable stratum, where it has both.

    One conditional aggregation per entity. Empty if fewer than two strata are usable.
    """
    usable = usable_strata(by_stratum, stratum, min_entities)
    low = usable.agg(F.min(stratum)).scalar()
    high = usable.agg(F.max(stratum)).scalar()
    bounded = by_stratum.select(
        entity, "name", stratum, "win_rate", low.alias("low_bracket"), high.alias("high_bracket")
    ).filter(F.col("low_bracket") < F.col("high_bracket"))
    at_low = F.col(stratum) == F.col("low_bracket")
    at_high = F.col(stratum) == F.col("high_bracket")
    return (
        bounded.filter(at_low | at_high)
        .groupBy(entity, "name", "low_bracket", "high_bracket")
        .agg(F.max(F.when(at_low, F.col("win_rate"))).alias("low"),
             F.max(F.when(at_high, F.col("win_rate"))).alias("high"))
        .filter(F.col("low").isNotNull() & F.col("high").isNotNull())
        .withColumn("delta_pp", (F.col("high") - F.col("low")) * 100)
    )


def top_divergence(pairs: DataFrame, k: int = 5, entity: str = "hero_id") -> DataFrame:
    """The k entities whose low and high rates differ most; ties go to the lower id."""
    return pairs.orderBy(F.abs("delta_pp").desc(), F.col(entity)).limit(k)


def extremes(rates: DataFrame, column: str, k: int, entity: str = "hero_id") -> DataFrame:
    """The k highest and k lowest rows of a column, labelled `most` and `least`, with a rank."""
    def end(label: str, ordering: Column) -> DataFrame:
        return rates.orderBy(ordering, F.col(entity)).limit(k).withColumn("end", F.lit(label))

    return end("most", F.col(column).desc()).unionByName(end("least", F.col(column).asc()))
