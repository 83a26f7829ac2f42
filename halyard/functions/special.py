"""Tails and quantiles of the distributions that the tests use, without a statistics library."""

from __future__ import annotations

import math


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def binomial_two_sided(less: int, greater: int) -> float:
    """Exact two-sided p of a fair coin; 1 if there was no throw."""
    n = less + greater
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(min(less, greater) + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, logs)))


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # by series for the lower part
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    tiny = 1e-300  # by Lentz's continued fraction
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def chi_square_tail(x: float, df: int) -> float:
    return gamma_tail(df / 2, x / 2)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + an * d or tiny)
            c = 1 + an / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_part(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def student_quantile(p: float, df: float) -> float:
    """By bisection; p between 0 and 1."""
    low, high = -1.0, 1.0
    while student_cdf(low, df) > p:
        low *= 2
    while student_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2
