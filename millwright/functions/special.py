"""Special functions and distributions in plain Python; none of them touches Spark."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    # Lentz's continued fraction for the upper function
    tiny = 1e-300
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
    return max(0.0, 1 - front * h)


def beta_i(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return min(1.0, front * h)


def bisect(f: Callable[[float], float], low: float, high: float, steps: int = 200) -> float:
    """A root of an increasing function between low and high."""
    for _ in range(steps):
        middle = (low + high) / 2
        if f(middle) < 0:
            low = middle
        else:
            high = middle
        if high - low <= 1e-15 * max(1.0, abs(high)):
            break
    return (low + high) / 2


def chi2_quantile(p: float, df: float) -> float:
    high = max(1.0, df)
    while gamma_p(df / 2, high / 2) < p:
        high *= 2
    return bisect(lambda x: gamma_p(df / 2, x / 2) - p, 0.0, high)


def poisson_pmf(k: int, mean: float) -> float:
    return math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else float(k == 0)


def poisson_quantile(p: float, mean: float) -> int:
    """Smallest k whose cumulative probability reaches p."""
    k = max(0, int(mean - 12 * math.sqrt(mean) - 12))
    total = 1 - gamma_p(k, mean) if k else 0.0
    while True:
        total += poisson_pmf(k, mean)
        if total >= p or k > mean + 40 * math.sqrt(mean) + 60:
            return k
        k += 1


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of more than k successes of n."""
    if k < 0:
        return 1.0
    return 0.0 if k >= n else beta_i(p, k + 1, n - k)


def f_tail(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_i(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / (df + t * t), df / 2, 0.5)


def golden_minimum(f: Callable[[float], float], low: float, high: float, steps: int = 120) -> tuple[float, float]:
    """Place and value of the minimum of a unimodal function."""
    r = (math.sqrt(5) - 1) / 2
    a, b = high - r * (high - low), low + r * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - r * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + r * (high - low)
            fb = f(b)
        if high - low < 1e-12 * max(1.0, high):
            break
    x = (low + high) / 2
    return x, f(x)
