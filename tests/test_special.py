"""Numeric tails against exact sums."""

from fractions import Fraction
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenhand.functions.proportions import wilson_interval
from evenhand.functions.special import binomial_p, binomial_two_sided, correlation_two_sided


def exact(k, n):
    m = min(k, n - k)
    return 1.0 if 2 * m == n else float(min(Fraction(1), Fraction(2 * sum(comb(n, i) for i in range(m + 1)), 2**n)))


@given(st.integers(1, 600), st.floats(0, 1))
@settings(max_examples=150, deadline=None)
def test_binomial_equals_the_exact_sum(n, share):
    k = round(n * share)
    assert binomial_two_sided(np.array([k]), np.array([n]))[0] == pytest.approx(exact(k, n), rel=1e-11)


def test_binomial_edges():
    k = np.array([0, 5, 10, 0, 1])
    n = np.array([10, 10, 10, 1, 1])
    assert binomial_two_sided(k, n) == pytest.approx([2 / 1024, 1.0, 2 / 1024, 1.0, 1.0])


def test_binomial_for_large_counts_near_the_middle():
    n = 10**9
    k = n // 2 + np.array([0, 1, 15_811, 50_000])
    p = binomial_two_sided(k, np.full(4, n))
    # Normal approximation with continuity correction: z = (|2k - n| - 1) / sqrt(n).
    from statistics import NormalDist
    z = (2.0 * (k - n // 2) - 1) / n**0.5
    assert p[0] == 1.0
    assert p[1:] == pytest.approx([2 * (1 - NormalDist().cdf(v)) for v in z[1:]], rel=1e-4)


def test_correlation_p_values():
    # Two and one degrees of freedom have elementary forms.
    assert correlation_two_sided(np.array([0.6]), np.array([4.0]))[0] == pytest.approx(0.4)
    assert correlation_two_sided(np.array([0.5]), np.array([3.0]))[0] == pytest.approx(2 / 3)
    assert correlation_two_sided(np.array([0.0, 1.0, -1.0]), np.array([9.0, 9.0, 9.0])) == pytest.approx([1.0, 0.0, 0.0])
    assert np.isnan(correlation_two_sided(np.array([0.5]), np.array([2.0]))[0])


def test_nulls_and_zero_trials(spark):
    df = spark.createDataFrame([(None, 5), (0, 0), (3, 6)], "k long, n long")
    assert [r.p for r in df.select(binomial_p("k", "n").alias("p")).collect()] == [None, None, 1.0]


def test_wilson_stays_inside_zero_and_one(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (1, 1)], "w long, g long")
    low, high = wilson_interval(F.col("w"), F.col("g"))
    for row in df.select(low.alias("lo"), high.alias("hi")).collect():
        assert -1e-15 <= row.lo < row.hi <= 1 + 1e-15
