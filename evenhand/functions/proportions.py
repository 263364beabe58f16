"""Closed forms for proportions as column arithmetic: intervals and experiment sizes."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_quantile(q: float) -> float:
    return NormalDist().inv_cdf(q)


def wilson_interval(wins: Column, games: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson score interval."""
    z = normal_quantile(1 - alpha / 2)
    n = games.cast("double")
    p = wins / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    reach = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return centre - reach, centre + reach


def games_per_group(p1: Column, p2: Column, z_alpha: Column, z_power: Column) -> Column:
    """Sample size per group of a two-sided two-proportion z-test, not rounded.

    Pooled variance under the null hypothesis, separate variances under the alternative.
    """
    pooled = (p1 + p2) / 2
    spread = z_alpha * F.sqrt(2 * pooled * (1 - pooled)) + z_power * F.sqrt(
        p1 * (1 - p1) + p2 * (1 - p2)
    )
    return spread * spread / ((p2 - p1) * (p2 - p1))


def detectable_effect(games: Column, p1: Column, z_alpha: Column, z_power: Column) -> Column:
    """Smallest rate shift that `games` per period can show."""
    return (z_alpha + z_power) * F.sqrt(2 * p1 * (1 - p1) / games)
