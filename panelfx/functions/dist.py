"""Normal, t and chi-squared distributions: plain numbers, and columns where Spark has the pieces."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_N = NormalDist()


def normal_cdf(z: float) -> float:
    return _N.cdf(z)


def normal_quantile(p: float) -> float:
    return _N.inv_cdf(p)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by a continued fraction, on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # evaluated from the end: 1 / (1 + d1 / (1 + d2 / (1 + ...)))
    value = 1.0
    for i in range(400, 0, -1):
        m = i // 2
        if i % 2 == 0:
            d = m * (b - m) * x / ((a + i - 1) * (a + i))
        else:
            d = -(a + m) * (a + b + m) * x / ((a + i - 1) * (a + i))
        value = 1 + d / value
    return front / value


def t_cdf(t: float, df: float) -> float:
    p = beta_i(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - p if t > 0 else p


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def normal_cdf_column(z: Column) -> Column:
    """The normal distribution function within 1e-15 or so, from Spark's exponential alone.

    A Taylor series of odd powers near 0, a continued fraction in the tails; both of fixed length.
    """
    a = F.abs(z)
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    series = F.lit(1.0)
    for k in range(60, 0, -1):
        series = 1 + a * a / (2 * k + 1) * series
    tail = a
    for k in range(60, 0, -1):
        tail = a + F.lit(float(k)) / tail
    upper = F.when(a < 3, F.lit(0.5) - density * a * series).otherwise(density / tail)
    return F.when(z >= 0, 1 - upper).otherwise(upper)
