"""Special functions and distributions, scalar and on the driver or inside tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for n in range(1, 1000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2) if x > 0 else 1.0


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf(x: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + x * x))
    return tail if x >= 0 else 1 - tail


def t_isf(p: float, df: float) -> float:
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf(mid, df) > p else (low, mid)
    return (low + high) / 2


def binom_pmf(k: int, n: int, p: float) -> float:
    if p in (0.0, 1.0):
        return float(k == n * p)
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def binom_cdf(k: int, n: int, p: float) -> float:
    return min(1.0, sum(binom_pmf(i, n, p) for i in range(k + 1)))


def binom_two_sided(k: int, n: int, p: float) -> float:
    """Sum of the outcomes no likelier than the one seen."""
    seen = binom_pmf(k, n, p)
    return min(1.0, sum(q for i in range(n + 1) if (q := binom_pmf(i, n, p)) <= seen * (1 + 1e-7)))


def poisson_sf(k: int, mean: float) -> float:
    """P(X >= k)."""
    return max(0.0, 1 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k))) if mean > 0 else float(k <= 0)


def kolmogorov_sf(d: float, n: int) -> float:
    """Asymptotic tail of the one-sample statistic, with Stephens' small-sample correction."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def kendall_tau(a: Sequence[float], b: Sequence[float]) -> float:
    """Tau-a, by counting inversions in a merge sort."""
    order = np.lexsort((b, a))
    seq = list(np.asarray(b)[order])

    def count(x: list[float]) -> tuple[list[float], int]:
        if len(x) < 2:
            return x, 0
        left, i = count(x[: len(x) // 2])
        right, j = count(x[len(x) // 2 :])
        out, n, k = [], i + j, 0
        for v in left:
            while k < len(right) and right[k] < v:
                out.append(right[k])
                k += 1
            n += k
            out.append(v)
        return out + right[k:], n

    n = len(seq)
    return 1 - 4 * count(seq)[1] / (n * (n - 1))


def poisson_binomial(probs: Sequence[float]) -> np.ndarray:
    """Distribution of the number of successes, by convolution."""
    pmf = np.array([1.0])
    for p in probs:
        pmf = np.append(pmf * (1 - p), 0.0) + np.append(0.0, pmf * p)
    return pmf
