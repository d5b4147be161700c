"""Special functions for p-values (no scipy here): regularised incomplete beta,
Student t and F(1, d) tails, normal tail, exact Mann-Whitney tail.

Pure Python/numpy helpers evaluated inside pandas UDFs over small pair tables.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_EPS = 1e-15
_TINY = 1e-300


def _betacf(a: float, b: float, x: float, max_iter: int = 500) -> float:
    """Continued fraction of the incomplete beta (modified Lentz)."""
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def _log_beta(a: float, b: float) -> float:
    """log B(a, b); for a large a the difference of two large log-gammas is taken by its
    series, log G(a + b) - log G(a) = b log a + b (b - 1) / (2 a) - b (b - 1) (2 b - 1) / (12 a^2) ..."""
    if a < b:
        a, b = b, a
    if a < 1e6 or b > 100:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    ratio = b * math.log(a) + b * (b - 1) / (2 * a) - b * (b - 1) * (2 * b - 1) / (12 * a * a)
    return math.lgamma(b) - ratio


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x where the caller knows it exactly."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    bt = math.exp(a * log_x + b * log_y - _log_beta(a, b))
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, y) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T_df| >= |t|)."""
    if t is None or df is None or not math.isfinite(df) or df <= 0 or t != t:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f1_sf(w: float, d: float) -> float:
    """Upper tail of F(1, d) at w (equals the two-sided t tail at sqrt(w))."""
    if w is None or d is None or w != w or d <= 0:
        return float("nan")
    return 1.0 if w <= 0 else t_two_sided(math.sqrt(w), d)


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def mwu_counts(m: int, n: int) -> list[int]:
    """Number of arrangements giving U = 0..m*n for sample sizes (m, n): the
    coefficients of the Gaussian binomial [m+n choose m]_q (exact integers)."""
    if m > n:
        m, n = n, m
    size = m * n + 1
    c = [0] * (size + n + m + 1)
    c[0] = 1
    deg = 0
    for i in range(1, m + 1):
        # multiply by (1 - q^(n+i)), then divide by (1 - q^i)
        k = n + i
        deg += k
        for j in range(min(deg, len(c) - 1), k - 1, -1):
            c[j] -= c[j - k]
        for j in range(i, min(deg, len(c) - 1) + 1):
            c[j] += c[j - i]
        deg -= i
    return c[:size]


@lru_cache(maxsize=16)
def _part_numerator(m: int) -> tuple[int, list[int]]:
    """(period, N): 1 / ((1 - q) (1 - q) (1 - q^2) .. (1 - q^m)) = N(q) / (1 - q^period)^(m + 1)."""
    period = math.lcm(*range(1, m + 1))
    num = [1]
    for p in (1, *range(1, m + 1)):
        out = [0] * (len(num) + period - p)
        for i, c in enumerate(num):
            for j in range(0, period, p):
                out[i + j] += c
        num = out
    return period, num


def _partitions_up_to(m: int, k: int) -> int:
    """Partitions of the numbers 0..k into parts of size 1..m (the doubled part 1 takes what is
    left over); the work follows lcm(1..m), not k."""
    period, num = _part_numerator(m)
    return sum(num[i] * math.comb((k - i) // period + m, m) for i in range(k % period, min(len(num), k + 1), period))


def mwu_tail(m: int, n: int, k: int) -> int:
    """Arrangements with U >= k for sample sizes m <= n, by symmetry those with U <= m n - k:
    the numerator of the Gaussian binomial has 2^m terms (-1)^|S| q^(sum of n + i in S)."""
    top = m * n - k
    if top < 0:
        return 0
    signed: dict[int, int] = {0: 1}
    for i in range(1, m + 1):
        for at, c in list(signed.items()):
            if at + n + i <= top:
                signed[at + n + i] = signed.get(at + n + i, 0) - c
    return sum(c * _partitions_up_to(m, top - at) for at, c in signed.items() if c)


def mwu_exact_two_sided(u1: float, n1: int, n2: int) -> float:
    """Exact two-sided p of Mann-Whitney (no ties): 2 * P(U >= max(U1, U2)), <= 1.  The work
    depends on the smaller sample only."""
    m, n = sorted((n1, n2))
    u = max(u1, n1 * n2 - u1)
    k = int(math.ceil(u - 1e-9))
    if m > 8:                                    # two samples of middle size: the plain table
        tail = sum(mwu_counts(n1, n2)[k:])
    else:
        tail = mwu_tail(m, n, k)
    return min(1.0, 2.0 * tail / math.comb(n1 + n2, n1))


def mwu_asymptotic_two_sided(u1: float, n1: int, n2: int, tie_term: float) -> float:
    """Normal approximation with tie correction and continuity correction."""
    n = n1 + n2
    mu = n1 * n2 / 2.0
    var = n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1)))
    if var <= 0:
        return float("nan")
    u = max(u1, n1 * n2 - u1)
    z = (u - mu - 0.5) / math.sqrt(var)
    return min(1.0, max(0.0, 2.0 * norm_sf(z)))


def mwu_two_sided(u1: float, n1: int, n2: int, tie_term: float, has_ties: bool) -> float:
    """Method choice: exact when a sample has at most 8 values and there are no ties."""
    if n1 == 0 or n2 == 0:
        return float("nan")
    if (n1 <= 8 or n2 <= 8) and not has_ties:
        return mwu_exact_two_sided(u1, int(n1), int(n2))
    return mwu_asymptotic_two_sided(u1, int(n1), int(n2), tie_term)


vt_two_sided = np.vectorize(t_two_sided, otypes=[float])
vf1_sf = np.vectorize(f1_sf, otypes=[float])
vmwu_two_sided = np.vectorize(mwu_two_sided, otypes=[float])
