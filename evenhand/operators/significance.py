"""Tests on rates: exact binomial, false-discovery control, tolerance verdicts, side and strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.proportions import wilson_interval
from evenhand.functions.special import binomial_p, correlation_p
from evenhand.operators.ranking import ROWS_PER_RANGE, running, with_range
from evenhand.operators.rates import low_high_pairs, top_divergence, usable_strata
from evenhand.workspace import settle

OVER, UNDER, WITHIN = "nerf candidate", "buff candidate", "within tolerance"


def with_interval(rates: DataFrame, alpha: float = 0.05, wins: str = "wins", games: str = "games") -> DataFrame:
    low, high = wilson_interval(F.col(wins), F.col(games), alpha)
    return rates.withColumns({"ci_low": low, "ci_high": high})


def with_binomial(rates: DataFrame, wins: str = "wins", games: str = "games", name: str = "p_value") -> DataFrame:
    """Exact two-sided p-value against one half, on rows that are already aggregated."""
    return rates.withColumn(name, binomial_p(F.col(wins), F.col(games)))


def action(tolerance: float, rate: str = "win_rate") -> Column:
    outside = F.col("outside_tolerance")
    return (
        F.when(outside & (F.col(rate) > 0.5), OVER)
        .when(outside & (F.col(rate) < 0.5), UNDER)
        .otherwise(WITHIN)
    )


def with_verdict(intervals: DataFrame, tolerance: float = 0.02, rate: str = "win_rate") -> DataFrame:
    """Flag entities whose whole interval lies outside 0.5 ± tolerance, and name the action."""
    outside = (F.col("ci_low") > 0.5 + tolerance) | (F.col("ci_high") < 0.5 - tolerance)
    return (
        intervals.withColumn("outside_tolerance", outside)
        .withColumn("action", action(tolerance, rate))
    )


def adjust_false_discovery(
    tests: DataFrame,
    alpha: float = 0.05,
    p: str = "p_value",
    family: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Benjamini–Hochberg `q_value` and `significant`, within each family of tests.

    Equal p-values have equal q-values, so the ranking runs on distinct ones with their counts:
    rank = running count, q = the smallest p * m / rank from here on. Tests without a family name
    are a family of their own; tests without a p-value get no q-value and do not count.
    """
    columns = tests.columns
    tests = settle(tests, "tests")
    keyed = tests.withColumn("_family", F.struct(*family) if family else F.struct(F.lit(1).alias("all")))
    sizes = keyed.groupBy("_family").agg(F.count(p).alias("_m"))
    steps = keyed.filter(F.col(p).isNotNull()).groupBy("_family", p).agg(F.count(F.lit(1)).alias("_n"))
    ranged = with_range(steps, ["_family", p], rows_per_range, at_most=tests.count())
    # Written, so that the second running pass does not plan the first one over again.
    ranked = settle(running(ranged, p, F.col("_n"), "_rank", ["_family"]).join(sizes, "_family"), "ranked-tests")
    stepped = running(
        ranked, p, F.col(p) * F.col("_m") / F.col("_rank"), "_q", ["_family"], how="min", descending=True
    )
    q = stepped.select("_family", p, F.least(F.lit(1.0), F.col("_q")).alias("q_value"))
    return (
        keyed.join(q, ["_family", p], "left")
        .withColumn("significant", F.col("q_value") <= alpha)
        .select(*columns, "q_value", "significant")
    )


def audit_entities(
    rates: DataFrame, min_games: int = 500, tolerance: float = 0.02, alpha: float = 0.05
) -> DataFrame:
    """The audit table: binomial test, corrected significance, interval and verdict per entity."""
    tested = with_binomial(rates.filter(F.col("games") >= min_games))
    return with_verdict(with_interval(adjust_false_discovery(tested, alpha), alpha), tolerance)


def flagged_names(tests: DataFrame, entity: str = "hero_id", rate: str = "win_rate") -> DataFrame:
    """Flagged entities as rows, with their rate and action."""
    return tests.filter("outside_tolerance").select(entity, "name", rate, "action")


def verdict_summary(
    tests: DataFrame, alpha: float = 0.05, rate: str = "win_rate", entity: str = "hero_id", names: bool = True
) -> DataFrame:
    """Counts before and after correction, and the flagged names ordered by rate.

    Lists of names are for reading. For rosters of any size leave them out with `names=False` (both
    are null then) and take `flagged_names`, which gives them as rows.
    """
    def listed(which: str) -> Column:
        if not names:
            return F.lit(None).cast("array<string>")
        chosen = F.collect_list(F.when(F.col("action") == which, F.struct(rate, entity, "name")))
        return F.transform(F.sort_array(chosen), lambda e: e["name"])

    return tests.agg(
        F.count(F.lit(1)).alias("heroes_tested"),
        F.count_if(F.col("p_value") < alpha).alias("significant_uncorrected"),
        (F.lit(alpha) * F.count(F.lit(1))).alias("expected_false_positives"),
        F.count_if("significant").alias("significant_after_bh"),
        F.count_if("outside_tolerance").alias("outside_tolerance"),
        listed(OVER).alias("nerf_candidates"),
        listed(UNDER).alias("buff_candidates"),
    )


def audit_sides(balance: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Binomial test, interval and advantage in percentage points of side A."""
    tested = with_interval(
        with_binomial(balance, "radiant_wins", "matches"), alpha, "radiant_wins", "matches"
    )
    return tested.withColumn("advantage_pp", (F.col("radiant_win_rate") - 0.5) * 100)


def correlate(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of two columns with its p-value and number of points."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fitted = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("correlation")
    )
    return fitted.withColumn("p_value", correlation_p(F.col("correlation"), F.col("n")))


def regress(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x: slope, intercept, r, p-value and number of points."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fitted = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(x, y).alias("r"),
    )
    return fitted.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def stratum_consistency(
    by_stratum: DataFrame, entity: str = "hero_id", stratum: str = "bracket",
    min_entities: int = 60, k: int = 5,
) -> DataFrame:
    """One row: usable strata, the lowest and highest compared, r, p and the k largest divergences.

    `by_stratum` is used several times; pass a stored table.
    """
    pairs = low_high_pairs(by_stratum, entity, stratum, min_entities)
    strata = usable_strata(by_stratum, stratum, min_entities).agg(
        F.sort_array(F.collect_list(stratum)).alias("brackets_compared")
    )
    # Sorting on (-|delta|, id) puts the largest divergence first and breaks ties by id.
    order = F.struct((-F.abs("delta_pp")).alias("size"), F.col(entity), "low", "high", "delta_pp")
    worst = top_divergence(pairs, k, entity).agg(F.sort_array(F.collect_list(order)).alias("worst"))
    fitted = pairs.agg(
        F.min("low_bracket").alias("low_bracket"), F.max("high_bracket").alias("high_bracket"),
        F.count(F.lit(1)).alias("n_heroes"), F.corr("low", "high").alias("correlation"),
    )
    return (
        fitted.withColumn("p_value", correlation_p(F.col("correlation"), F.col("n_heroes")))
        .withColumn("brackets_compared", strata.scalar())
        .withColumn("_worst", worst.scalar())
        .withColumn("biggest_divergence", F.transform(
            "_worst", lambda e: F.struct(e[entity].alias(entity), e["low"].alias("low"), e["high"].alias("high"),
                                         e["delta_pp"].alias("delta_pp"))))
        .drop("_worst")
    )
