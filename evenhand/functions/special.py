"""Tail probabilities that Spark SQL has no function for, as Arrow-batched pandas UDFs.

Everything is evaluated on whole numpy arrays. The incomplete beta function is taken from its
continued fraction; prefactors stay in logarithms so that tails down to about 1e-308 keep their
relative precision.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get these functions with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by the modified Lentz method.

    Converges fast for x < (a + 1) / (a + b + 2), in at most O(sqrt(max(a, b))) steps.
    """
    c = np.ones_like(a)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    value = d.copy()
    live = np.arange(a.size)
    steps = int(200 + 20 * math.sqrt(float(np.max(np.maximum(a, b), initial=1.0))))
    for m in range(1, steps + 1):
        aa, bb, xx = a[live], b[live], x[live]
        even = m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m))
        odd = -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))
        cl, dl = c[live], d[live]
        factor = np.ones_like(aa)
        for term in (even, odd):
            dl = 1.0 + term * dl
            dl = 1.0 / np.where(np.abs(dl) < _TINY, _TINY, dl)
            cl = 1.0 + term / cl
            cl = np.where(np.abs(cl) < _TINY, _TINY, cl)
            factor = factor * dl * cl
        c[live], d[live] = cl, dl
        value[live] *= factor
        live = live[np.abs(cl * dl - 1.0) > 1e-15]
        if live.size == 0:
            break
    return value


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log(n!) minus Stirling's formula; the part that keeps large binomials exact."""
    n = np.asarray(n, dtype=float)
    small = n < 16
    exact = np.array([
        math.lgamma(k + 1.0) - ((k + 0.5) * math.log(k) - k + 0.5 * math.log(2 * math.pi)) if k else 0.0
        for k in range(16)
    ])
    big = np.where(small, 16.0, n)
    inv2 = 1.0 / (big * big)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - inv2 / 1188) * inv2) * inv2) * inv2) / big
    return np.where(small, exact[np.where(small, n, 0).astype(int)], series)


def _log_even_binomial(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log of C(n, k) / 2**n by the saddle-point expansion (Loader, 2000)."""
    out = np.empty_like(n)
    edge = k == 0
    out[edge] = -n[edge] * math.log(2.0)
    k, n = k[~edge], n[~edge]
    half = n / 2.0
    # Deviance k log(2k/n) + (n-k) log(2(n-k)/n), through log1p of the relative offset.
    off = (k - half) / half
    deviance = half * ((1 + off) * np.log1p(off) + (1 - off) * np.log1p(-off))
    correction = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k)
    out[~edge] = correction - deviance + 0.5 * np.log(n / (2 * math.pi * k * (n - k)))
    return out


def binomial_two_sided(successes: np.ndarray, trials: np.ndarray) -> np.ndarray:
    """Exact two-sided p-value against a success probability of one half."""
    k = np.asarray(successes, dtype=float)
    n = np.asarray(trials, dtype=float)
    m = np.minimum(k, n - k)
    p = np.ones_like(n)
    off = 2 * m < n
    if off.any():
        mm, nn = m[off], n[off]
        # P(X <= m) = I_1/2(n - m, m + 1), whose prefactor is half the point mass at m.
        fraction = _beta_fraction(nn - mm, mm + 1.0, np.full_like(nn, 0.5))
        p[off] = np.minimum(1.0, np.exp(_log_even_binomial(mm, nn)) * fraction)
    return p


def _log_gamma_half_step(z: np.ndarray) -> np.ndarray:
    """log Gamma(z + 1/2) - log Gamma(z) without cancellation for large z."""
    direct = np.array([math.lgamma(v + 0.5) - math.lgamma(v) for v in np.minimum(z, 1e4)])
    safe = np.maximum(z, 1e4)
    return np.where(z <= 1e4, direct, 0.5 * np.log(safe) - 1 / (8 * safe) + 1 / (192 * safe**3))


def correlation_two_sided(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-value of a Pearson correlation (equally of a simple-regression slope)."""
    r = np.asarray(r, dtype=float)
    df = np.asarray(n, dtype=float) - 2.0
    p = np.full(r.shape, np.nan)
    p[(df > 0) & (np.abs(r) >= 1)] = 0.0
    use = (df > 0) & (np.abs(r) < 1)
    if use.any():
        a, b = df[use] / 2.0, np.full(int(use.sum()), 0.5)
        t, u = 1.0 - r[use] ** 2, r[use] ** 2
        log_front = _log_gamma_half_step(a) - math.lgamma(0.5) + a * np.log1p(-u) + 0.5 * np.log(np.maximum(u, _TINY))
        front = np.exp(log_front)
        direct = t < (a + 1) / (a + b + 2)
        out = np.empty_like(a)
        out[direct] = front[direct] * _beta_fraction(a[direct], b[direct], t[direct]) / a[direct]
        rest = ~direct
        out[rest] = 1.0 - front[rest] * _beta_fraction(b[rest], a[rest], u[rest]) / b[rest]
        p[use] = out
    return p


@F.pandas_udf(T.DoubleType())
def _binomial_udf(successes: pd.Series, trials: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=trials.index, dtype=float)
    known = successes.notna() & trials.notna() & (trials > 0)
    out[known] = binomial_two_sided(successes[known].to_numpy(float), trials[known].to_numpy(float))
    return out.where(known, None)


@F.pandas_udf(T.DoubleType())
def _correlation_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    p = correlation_two_sided(r.to_numpy(float), n.to_numpy(float))
    return pd.Series(p).where(~np.isnan(p), None)


@F.pandas_udf(T.DoubleType())
def _erfc_udf(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


def binomial_p(successes: Column | str, trials: Column | str) -> Column:
    """Exact two-sided binomial p-value against 1/2; null for zero trials."""
    return _binomial_udf(successes, trials)


def correlation_p(r: Column | str, n: Column | str) -> Column:
    """p-value of a correlation over n points (n - 2 degrees of freedom)."""
    return _correlation_udf(r, n)


def chi_square_1_p(statistic: Column | str) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    stat = F.col(statistic) if isinstance(statistic, str) else statistic
    return _erfc_udf(F.sqrt(stat / 2.0))
