"""Scalar distribution functions for one-row results (no SciPy needed)."""

from __future__ import annotations

import math


def chi2_tail(x: float, df: float) -> float:
    """P(X > x) of a chi-square: regularised upper incomplete gamma."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_cdf(t: float, df: float) -> float:
    """Student t distribution function, through the incomplete beta's continued fraction."""
    x = df / (df + t * t)
    tail = 0.5 * _beta_share(df / 2, 0.5, x)
    return 1 - tail if t > 0 else tail


def _beta_share(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    )
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + up * d or tiny)
        c = 1 + up / c or tiny
        h *= d * c
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + down * d or tiny)
        c = 1 + down / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def t_quantile(p: float, df: float) -> float:
    """Inverse of :func:`t_cdf` by bisection."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if t_cdf(mid, df) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
