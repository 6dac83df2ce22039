"""Distribution functions on the driver, for test statistics that Spark has aggregated to a few numbers."""

from __future__ import annotations

import math


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By bisection, to double precision's reach."""
    return _bisect(normal_cdf, p, -40.0, 40.0)


def _bisect(f, p: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < p else (lo, mid)
    return (lo + hi) / 2


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def gamma_inc(a: float, x: float) -> float:
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
        return min(1.0, total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        b += 2
        step = -i * (i - a)
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def t_cdf(t: float, df: float) -> float:
    tail = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    return _bisect(lambda x: t_cdf(x, df), p, -1e4, 1e4)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_inc(df / 2, x / 2)


def kolmogorov_sf(x: float) -> float:
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101)))) if x > 0.2 else 1.0


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """Chance that the range of k standard normal means over an independent deviation exceeds q: nested Simpson sums."""

    def within(w: float) -> float:
        n, lo, hi = 64, -8.0, 8.0
        h = (hi - lo) / n
        f = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (normal_cdf(z + w) - normal_cdf(z)) ** (k - 1)
        return k * h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(lo + i * h) for i in range(n + 1))

    log_c = df / 2 * math.log(df / 2) - math.lgamma(df / 2) + math.log(2)
    n, hi = 48, 1 + 8 / math.sqrt(2 * df)
    h = hi / n
    g = lambda s: 0.0 if s == 0 else math.exp(log_c + (df - 1) * math.log(s) - df * s * s / 2) * within(q * s)
    return max(0.0, min(1.0, 1 - h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * g(i * h) for i in range(n + 1))))


def hypergeom_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of a 2 x 2 table: the chance of all tables as unlikely as this one."""
    n, r, k = a + b + c + d, a + b, a + c
    log_comb = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    p = lambda x: math.exp(log_comb(r, x) + log_comb(n - r, k - x) - log_comb(n, k))
    own = p(a)
    return min(1.0, sum(q for x in range(max(0, k - (n - r)), min(r, k) + 1) if (q := p(x)) <= own * (1 + 1e-7)))
