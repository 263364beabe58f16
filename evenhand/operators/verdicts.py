"""The audit table as readers see it: filtered, searched, formatted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.operators.significance import OVER, UNDER

SMALL_Q = 0.001


def percent(rate: str) -> Column:
    """Percent with two decimals, exact halves to the even digit as printf does."""
    return F.bround(F.col(rate) * 100, 2)


def verdict_view(tests: DataFrame, verdict: str = "all", search: str = "", ordered: bool = True) -> DataFrame:
    """Formatted rows of `audit_entities`, by verdict and case-insensitive pattern.

    `verdict` is one of `all`, `outside`, `over`, `under`.
    """
    chosen = {
        "all": F.lit(True),
        "outside": F.col("outside_tolerance"),
        "over": F.col("action") == OVER,
        "under": F.col("action") == UNDER,
    }[verdict]
    kept = tests.filter(chosen)
    if search:
        kept = kept.filter(F.col("name").rlike(f"(?i){search}"))
    view = kept.select(
        F.col("name").alias("hero"),
        F.format_number("games", 0).alias("games"),
        F.format_string("%.2f%%", percent("win_rate")).alias("win_rate"),
        F.format_string("[%.2f%%, %.2f%%]", percent("ci_low"), percent("ci_high")).alias("interval_95"),
        F.when(F.col("q_value") < SMALL_Q, F.format_string("%.2e", "q_value"))
        .otherwise(F.format_string("%.4f", "q_value")).alias("q_value"),
        F.col("action").alias("verdict"),
    )
    return view.orderBy("hero") if ordered else view
