"""Quantiles: Student's t by bisection on a series for its distribution; the normal distribution and sorted arrays as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_cdf(x: float, df: int) -> float:
    """Distribution of t for whole degrees of freedom (finite trigonometric series)."""
    theta = math.atan(x / math.sqrt(df))
    c = math.cos(theta)
    if df % 2:
        term, total = c, 0.0
        for j in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c * c * (2 * j) / (2 * j + 1)
        return 0.5 + (theta + math.sin(theta) * total) / math.pi
    term, total = 1.0, 0.0
    for j in range(1, df // 2 + 1):
        total += term
        term *= c * c * (2 * j - 1) / (2 * j)
    return 0.5 + math.sin(theta) * total / 2


def t_quantile(p: float, df: int) -> float:
    low, high = -1000.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


# ---------------------------------------------------------------- columns

#: Published coefficients of the normal distribution's rational approximations (distribution: error below
#: 7.5e-8; quantile: relative error below 1.15e-9).
CDF_P, CDF_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
PPF_TAIL = 0.02425


def polynomial(x: Column, terms: tuple[float, ...]) -> Column:
    """Highest power first."""
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * x + F.lit(t)
    return out


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + CDF_P * F.abs(x))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * polynomial(t, CDF_B[::-1])
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """For 0 < p < 1."""
    centre = p - 0.5
    tail = lambda q: polynomial(F.sqrt(-2 * F.log(q)), PPF_C) / polynomial(F.sqrt(-2 * F.log(q)), PPF_D)
    middle = polynomial(centre * centre, PPF_A) * centre / polynomial(centre * centre, PPF_B)
    return F.when(p < PPF_TAIL, tail(p)).when(p > 1 - PPF_TAIL, -tail(1 - p)).otherwise(middle)


def sorted_quantile(values: Column, p: Column) -> Column:
    """The p-quantile of a sorted array, between its order statistics."""
    at = (F.size(values) - 1) * p
    low = F.floor(at).cast("int")
    a, b = F.element_at(values, low + 1), F.element_at(values, F.least(low + 2, F.size(values)))
    return a + (at - low) * (b - a)



#: Terms of the series of the incomplete beta function, and halvings in the search of its inverse.
TERMS, HALVINGS = 1000, 60


def log_gamma(x: Column) -> Column:
    """For x > 0, by Stirling's series of x + 10 (relative error below 1e-13)."""
    up = x + 10
    product = x
    for k in range(1, 10):
        product = product * (x + k)
    r = 1 / (up * up)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / up
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _beta_series(x: Column, a: Column, b: Column) -> Column:
    """The share of the beta distribution below x, for x up to one half: a series of positive terms, each from the one before.

    The ratio of two terms falls to x, from about x (a + b) / a: over x (a + b) / (1 - x) terms are past their largest.
    """
    step = lambda s, n: F.struct((s["t"] * (a + b + n) / (a + 1 + n) * x).alias("t"), (s["s"] + s["t"]).alias("s"))
    terms = F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")), step, lambda s: s["s"])
    return F.exp(a * F.log(x) + b * F.log(1 - x) - F.log(a) - (log_gamma(a) + log_gamma(b) - log_gamma(a + b))) * terms


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function of 0 < x < 1."""
    return F.when(x <= 0.5, _beta_series(x, a, b)).otherwise(1 - _beta_series(1 - x, b, a))


def f_quantile(p: float, d1: Column, d2: Column) -> Column:
    """The p-quantile of Fisher's F: the place where beta_share(d1 / 2, d2 / 2) is p, found by halving."""
    a, b = d1 / F.lit(2.0), d2 / F.lit(2.0)

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        below = beta_share(mid, a, b) < p
        return F.struct(F.when(below, mid).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(mid).alias("high"))

    x = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), halve, lambda s: (s["low"] + s["high"]) / 2)
    return d2 * x / (d1 * (1 - x))
