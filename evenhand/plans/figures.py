"""The tables behind the figures; drawing is left to the reader's tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions.proportions import normal_quantile
from evenhand.models.evaluation import calibration, histogram
from evenhand.operators.ranking import with_global_index
from evenhand.operators.rates import top_divergence
from evenhand.plans.training import strongest_weights
from evenhand.workspace import settle


def forest(tests: DataFrame, tolerance: float = 0.02, entity: str = "hero_id") -> DataFrame:
    """Rate, interval, class and vertical position of every entity, lowest rate first."""
    classed = tests.select(
        entity, "name", "win_rate", "ci_low", "ci_high",
        F.when(F.col("ci_high") < 0.5 - tolerance, "cold").when(F.col("ci_low") > 0.5 + tolerance, "hot")
        .otherwise("muted").alias("colour"),
        F.struct("win_rate", entity).alias("_order"),
    )
    return with_global_index(classed, "_order", "position").drop("_order")


def power_curve(
    rates: DataFrame, low: float = 0.005, high: float = 0.05, points: int = 200, alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Games per period along an even grid of effects, with a variance of 1/4 in both periods, and
    the number of entities that already have them. A rougher formula than `games_per_group`."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    step = (high - low) / (points - 1)
    effect = F.lit(low) + F.col("point") * step
    curve = rates.select("games", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    needed = z * z * 0.5 / (effect * effect)
    enough = curve.groupBy("point").agg(F.count_if(F.col("games") >= needed).alias("heroes_with_enough"))
    grid = rates.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))  # also without entities
    return grid.join(enough, "point", "left").fillna(0, ["heroes_with_enough"]).select(
        "point", (effect * 100).alias("effect_pp"), needed.alias("hero_games"), "heroes_with_enough")


def detectable_points(sized: DataFrame) -> DataFrame:
    """Pick rate against trials needed, from `trials_needed`."""
    return sized.select("name", (F.col("pick_rate") * 100).alias("pick_rate_pct"), "matches_needed")


def low_high_scatter(pairs: DataFrame, k: int = 4, margin: float = 0.02) -> DataFrame:
    """Low against high stratum, axis limits, and names for the k most divergent. Pass a stored table."""
    limits = pairs.agg(F.struct(
        (F.least(F.min("low"), F.min("high")) - margin).alias("lo"),
        (F.greatest(F.max("low"), F.max("high")) + margin).alias("hi"))).scalar()
    named = top_divergence(pairs, k).select("hero_id", F.col("name").alias("label"))
    return (
        pairs.join(named, "hero_id", "left").withColumn("_l", limits)
        .select("hero_id", "low", "high", "label", F.col("_l.lo").alias("axis_low"), F.col("_l.hi").alias("axis_high"))
    )


def before_after_scatter(moved: DataFrame, margin: float = 0.01) -> DataFrame:
    """Rate before against rate after by verdict, touched flag, label and axis limits. Pass a stored table."""
    limits = moved.agg(F.struct(
        (F.least(F.min("win_rate_mine"), F.min("win_rate_live")) - margin).alias("lo"),
        (F.greatest(F.max("win_rate_mine"), F.max("win_rate_live")) + margin).alias("hi"))).scalar()
    touched = F.col("patch_touched") != "untouched"
    return moved.withColumn("_l", limits).select(
        "hero_id", "win_rate_mine", "win_rate_live", "action", touched.alias("touched"),
        F.when(touched, F.concat("name", F.lit(" ("), "patch_touched", F.lit(")"))).alias("label"),
        F.col("_l.lo").alias("axis_low"), F.col("_l.hi").alias("axis_high"))


def probability_bars(predictions: DataFrame, bins: int = 60) -> DataFrame:
    return histogram(predictions, bins)


def calibration_points(predictions: DataFrame, bins: int = 10, margin: float = 0.03) -> DataFrame:
    """Calibration bins with common axis limits."""
    points = settle(calibration(predictions, bins), "calibration")
    limits = points.agg(F.struct(
        (F.least(F.min("prob_pred"), F.min("prob_true")) - margin).alias("lo"),
        (F.greatest(F.max("prob_pred"), F.max("prob_true")) + margin).alias("hi"))).scalar()
    return points.withColumn("_l", limits).select(
        "bin", "n", "prob_true", "prob_pred", F.col("_l.lo").alias("axis_low"), F.col("_l.hi").alias("axis_high"))


def weight_bars(weights: DataFrame, dimension: DataFrame, k: int = 15) -> DataFrame:
    """The strongest weights each way with the side they favour."""
    return strongest_weights(weights, dimension, k).withColumn(
        "favours", F.when(F.col("weight") > 0, "radiant").otherwise("dire"))
