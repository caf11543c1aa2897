"""Student t, normal and binomial distributions on the driver, from the standard library."""

from __future__ import annotations

from math import exp, lgamma, log, sqrt
from statistics import NormalDist

NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    first = 1 - (a + b) * x / (a + 1)
    c, d = 1.0, 1 / (first if abs(first) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if t in (float("inf"), float("-inf")):
        return float(t < 0)
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_ppf(p: float, df: float) -> float:
    """Quantile by bisection; exact to double precision of the tail."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    lo, hi = -1.0, 1.0
    while 1 - t_sf(lo, df) > p:
        lo *= 2
    while 1 - t_sf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_sf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def binomial_ppf(q: float, n: int, p: float) -> int:
    """Smallest k with P(X <= k) >= q."""
    total = 0.0
    for k in range(n + 1):
        total += exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p))
        if total >= q - 1e-12:
            return k
    return n


def chance_level(n_samples: int, n_classes: int = 2, alpha: float = 0.05) -> float:
    """The accuracy that guessing reaches or exceeds with probability ``alpha`` at most."""
    return binomial_ppf(1 - alpha, n_samples, 1 / n_classes) / n_samples


def hedges_factor(df: int) -> float:
    return 1 - 3 / (4 * df - 1)


def fisher_interval(rho: float, n: int, z: float = 1.96) -> tuple[float, float]:
    from math import atanh, tanh

    if n <= 3 or abs(rho) >= 1:
        return rho, rho
    half = z / sqrt(n - 3)
    return tanh(atanh(rho) - half), tanh(atanh(rho) + half)
