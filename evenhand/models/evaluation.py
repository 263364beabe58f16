"""Metrics of predicted probabilities: scores, calibration, spread, paired comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.special import chi_square_1_p
from evenhand.operators.ranking import ROWS_PER_RANGE, exact_quantiles, running, with_range
from evenhand.workspace import settle

_EPS = 2.220446049250313e-16


def log_loss(p: Column, y: Column) -> Column:
    clipped = F.greatest(F.lit(_EPS), F.least(F.lit(1 - _EPS), p))
    return -F.ln(F.when(y == 1, clipped).otherwise(1 - clipped))


def is_correct(p: Column, y: Column) -> Column:
    return (p >= 0.5) == (y == 1)


def area_under_roc(
    predictions: DataFrame, by: Sequence[str] = ("model",), p: str = "p", y: str = "y",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Exact tie-aware AUC per group: the share of (positive, negative) pairs ranked right, ties half.

    Rows are first counted per distinct score, then negatives are summed along the score.
    """
    predictions = settle(predictions, "predictions")
    counts = predictions.groupBy(*by, p).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )
    ranged = with_range(counts, [*by, p], rows_per_range, at_most=predictions.count())
    ranked = running(ranged, p, F.col("neg"), "neg_to_here", by)
    wins = F.col("pos").cast("double") * (F.col("neg_to_here") - F.col("neg") / 2)
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(wins), pairs).alias("roc_auc"))


def metrics(
    predictions: DataFrame, by: Sequence[str] = ("model",), p: str = "p", y: str = "y",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Accuracy at p >= 0.5, log loss, Brier score and exact AUC per group."""
    predictions = settle(predictions, "predictions")
    pc, yc = F.col(p), F.col(y)
    scores = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(is_correct(pc, yc).cast("double")).alias("accuracy"),
        F.avg(log_loss(pc, yc)).alias("log_loss"),
        F.avg((pc - yc) * (pc - yc)).alias("brier"),
    )
    return scores.join(area_under_roc(predictions, by, p, y, rows_per_range), list(by))


def calibration(predictions: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Mean outcome and mean prediction per quantile bin; a value on an edge goes to the lower bin.

    For the predictions of one model. Edges are exact quantiles.
    """
    edges = exact_quantiles(predictions, p, [i / bins for i in range(1, bins)])
    above = sum(((F.col(p) > F.lit(e)).cast("int") for e in edges), F.lit(0))
    return (
        predictions.groupBy(above.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("prob_true"), F.avg(p).alias("prob_pred"))
    )


def probability_spread(predictions: DataFrame, p: str = "p", meaningful: float = 0.05) -> DataFrame:
    """One row: extremes, exact 1st and 99th percentile and median edge, population deviation,
    and the share of predictions more than `meaningful` off even."""
    edge = F.abs(F.col(p) - 0.5)
    p1, p99 = exact_quantiles(predictions, p, [0.01, 0.99])
    (middle,) = exact_quantiles(predictions.select(edge.alias("edge")), "edge", [0.5])
    return predictions.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(p).alias("min"), F.max(p).alias("max"),
        F.lit(p1).alias("p1"), F.lit(p99).alias("p99"),
        (F.stddev_pop(p) * 100).alias("sd_pp"),
        F.avg((edge > meaningful).cast("double")).alias("share_meaningfully_decided"),
        F.lit(middle * 100).alias("median_edge_pp"),
    )


def histogram(predictions: DataFrame, bins: int = 60, p: str = "p") -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed."""
    low, high = predictions.agg(F.min(p), F.max(p)).first()
    if low is None:
        return predictions.select(F.lit(0).alias("bin"), F.lit(0.0).alias("left_edge"), F.lit(0).cast("bigint").alias("n")).limit(0)
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    slot = F.least(F.floor((F.col(p) - low) / width).cast("int"), F.lit(bins - 1))
    counted = predictions.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.lit(low) + F.col("bin") * width).alias("left_edge"), "n")


def paired_correctness(
    predictions: DataFrame, base: str, other: str, trial: str = "match_id", p: str = "p", y: str = "y"
) -> DataFrame:
    """One row with the 2×2 table of `base` against `other` on the trials both predicted."""
    right = is_correct(F.col(p), F.col(y)).cast("int")
    paired = (
        predictions.filter(F.col("model").isin(base, other))
        .groupBy(trial).agg(F.max(F.when(F.col("model") == base, right)).alias("a"),
                            F.max(F.when(F.col("model") == other, right)).alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    a, b = F.col("a") == 1, F.col("b") == 1
    return paired.agg(
        F.lit(other).alias("compared_with"),
        F.count_if(a & b).alias("both_right"), F.count_if(a & ~b).alias("only_base"),
        F.count_if(~a & b).alias("only_other"), F.count_if(~a & ~b).alias("both_wrong"),
    )


def with_mcnemar(tables: DataFrame, alpha: float = 0.05) -> DataFrame:
    """McNemar's statistic with continuity correction, its p-value, and a verdict."""
    b, c = F.col("only_base"), F.col("only_other")
    gap = F.abs(b - c) - 1
    return (
        tables.withColumn("statistic", F.try_divide((gap * gap).cast("double"), (b + c).cast("double")))
        .withColumn("p_value", chi_square_1_p("statistic"))
        .withColumn("verdict", F.when(F.col("p_value") < alpha, "significant").otherwise("no significant difference"))
    )
