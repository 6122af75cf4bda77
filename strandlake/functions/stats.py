"""Scalar statistics: Poisson and binomial tails, normal and chi-square, as numpy kernels and Spark functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LN10 = math.log(10)
#: log n! up to here is exact to rounding; beyond, Stirling's series.
_SMALL = 64


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Natural log of n! for whole n >= 0."""
    n = np.asarray(n, np.float64)
    table = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, _SMALL)))))
    big = np.maximum(n, _SMALL)
    series = big * np.log(big) - big + 0.5 * np.log(2 * np.pi * big) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return np.where(n < _SMALL, table[np.minimum(n, _SMALL - 1).astype(np.int64)], series)


def poisson_score(k: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """-log10 P(X > k) for X Poisson with mean lam, in log space throughout.

    Above the mean the upper tail is its first term times a falling series;
    below it the lower tail is summed the same way and taken from one.  A mean
    of zero gives an infinite score, a negative or missing one NaN.
    """
    k = np.maximum(np.asarray(k, np.float64), -1)
    lam = np.asarray(lam, np.float64)
    out = np.full(np.broadcast(k, lam).shape, np.nan)
    k, lam = np.broadcast_to(k, out.shape), np.broadcast_to(lam, out.shape)
    out[(lam == 0) & (k >= 0)] = np.inf
    out[(lam >= 0) & (k < 0)] = 0.0
    live = (lam > 0) & (k >= 0)
    upper = live & (k + 1 >= lam)
    lower = live & ~upper
    if upper.any():
        a, x = k[upper] + 1, lam[upper]
        first = -x + a * np.log(x) - log_factorial(a)
        out[upper] = -(first + np.log(_falling(lambda i: x / (a + i)))) / LN10
    if lower.any():
        a, x = k[lower], lam[lower]
        first = -x + a * np.log(x) - log_factorial(a)
        below = np.exp(first + np.log(_falling(lambda i: np.maximum(a - i + 1, 0) / x)))
        out[lower] = -np.log1p(-np.minimum(below, 1 - 1e-16)) / LN10
    return out


def _falling(ratio) -> np.ndarray:
    """1 + r1 + r1 r2 + ... until no term counts."""
    term = ratio(1)
    total = 1 + term
    i = 2
    while (term > 1e-17 * total).any():
        term = term * ratio(i)
        total = total + term
        i += 1
    return total


def _score_batch(k: pd.Series, lam: pd.Series) -> pd.Series:
    pairs, where = np.unique(np.column_stack((k.to_numpy(np.float64), lam.to_numpy(np.float64))), axis=0, return_inverse=True)
    return pd.Series(poisson_score(pairs[:, 0], pairs[:, 1])[where.ravel()])


def poisson_score_column(k: Column | str, lam: Column | str) -> Column:
    """``poisson_score`` of columns in Arrow batches."""
    return F.pandas_udf(_score_batch, DoubleType())(k, lam)


def binomial_max_duplicates(total: int, genome_size: float, confidence: float = 1 - 1e-5) -> int:
    """The least x, one at least, with P(Binomial(total, 1/genome_size) <= x) >= confidence."""
    if total <= 0:
        return 1
    p = 1 / genome_size
    log_p, log_q = math.log(p), math.log1p(-p) if p < 1 else -math.inf
    mass, x = 0.0, 0
    while x <= total:
        log_choose = math.lgamma(total + 1) - math.lgamma(x + 1) - math.lgamma(total - x + 1)
        mass += math.exp(log_choose + x * log_p + (total - x) * log_q) if p < 1 else float(x == total)
        if mass >= confidence:
            break
        x += 1
    return max(1, x)


def fold_enrichment(treat: Column, control: Column, pseudo: float = 1.0) -> Column:
    """(treat + pseudo) / (control + pseudo)."""
    return (treat + F.lit(pseudo)) / (control + F.lit(pseudo))


def log_likelihood_ratio(x: Column, y: Column, pseudo: float = 1.0) -> Column:
    """log10 likelihood ratio of x enriched over y, negative where y is the larger."""
    a, b = x + F.lit(pseudo), y + F.lit(pseudo)
    size = (a * (F.log(a) - F.log(b)) + b - a) / F.lit(LN10)
    return F.when(a > b, size).when(a < b, -size).otherwise(F.lit(0.0))


def symmetric_log_likelihood_ratio(x: Column, y: Column, pseudo: float = 1.0) -> Column:
    """log10 likelihood ratio between two conditions, signed by the larger."""
    a, b = x + F.lit(pseudo), y + F.lit(pseudo)
    mean = (a + b) / 2
    size = (a * F.log(a / mean) + b * F.log(b / mean)) / F.lit(LN10)
    return F.when(a > b, size).when(a < b, -size).otherwise(F.lit(0.0))


def normal_cdf(z: float) -> float:
    """P(Z <= z) of the standard normal."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi_square_score(x: float, df: int) -> float:
    """-log10 of the upper tail of chi-square, by the regularised gamma function."""
    if x <= 0:
        return 0.0
    a, half = df / 2, x / 2
    scale = -half + a * math.log(half) - math.lgamma(a)
    if half < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= half / n
            total += term
        return -math.log10(max(1e-300, 1 - total * math.exp(scale)))
    # continued fraction, modified Lentz
    b = half + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return -(scale + math.log(h)) / LN10
