"""Tail probabilities as column expressions: normal, Student's t, and the p-values of rank tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of a Chebyshev fit of the complementary error function (relative error
#: under 1.2e-7) and of Lanczos' series of the gamma function (g = 7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Beyond so many degrees of freedom Student's tail is taken from the normal one.
FAR = 10_000
STEPS = 300


def normal_tail(z: Column) -> Column:
    """P(Z > z)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    series = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        series = F.lit(c) + t * series
    tail = t * F.exp(-x * x + series) / 2.0
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def log_gamma(x: Column) -> Column:
    """For x > 0.5."""
    y = x - 1.0
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + float(i))
    t = y + 7.5
    return 0.9189385332046727 + (y + 0.5) * F.log(t) - t + F.log(total)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's way: pairs of steps until
    they change nothing; it ends early for x < (a + 1) / (a + b + 2)."""
    tiny = F.lit(1e-300)
    guard = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    d0 = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * s["d"])
        c = guard(1.0 + even / s["c"])
        h = s["h"] * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d2 = 1.0 / guard(1.0 + odd * d)
        c2 = guard(1.0 + odd / c)
        return F.struct(c2.alias("c"), d2.alias("d"), (h * d2 * c2).alias("h"))

    steps = F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double"))
    return F.aggregate(steps, start, step)["h"]


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""
    x, a, b = (c.cast("double") for c in (x, a, b))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    turned = x > (a + 1.0) / (a + b + 2.0)
    p, q = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b)
    part = front * _fraction(p, q, F.when(turned, 1.0 - x).otherwise(x)) / p
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(turned, 1.0 - part).otherwise(part))


def student_two_sided(t: Column, freedom: Column) -> Column:
    """P(|T| > |t|) of Student's distribution."""
    near = beta_share(freedom / (freedom + t * t), freedom / 2.0, F.lit(0.50000000000001))
    far = 2.0 * normal_tail(F.abs(t) * (1.0 - 1.0 / (4.0 * freedom)) / F.sqrt(1.0 + t * t / (2.0 * freedom)))
    return F.when(freedom > FAR, far).otherwise(near)


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank (or product-moment) correlation; null under three rows, 0 where it is 1."""
    freedom = (n - 2).cast("double")
    t = rho * F.sqrt(freedom / ((1.0 - rho) * (1.0 + rho)))
    return F.when(n < 3, None).when(F.abs(rho) >= 1.0, 0.0).otherwise(student_two_sided(t, freedom))


def wilcoxon_p(w: Column, n: Column, ties: Column) -> Column:
    """Two-sided p of the signed-rank statistic, by the normal law; `ties`: the sum of k^3 - k over
    groups of equal ranks."""
    n = n.cast("double")
    se = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)
    return F.least(F.lit(1.0), 2.0 * normal_tail(F.abs(F.try_divide(w - n * (n + 1) / 4.0, se))))


def mann_whitney_p(u: Column, n1: Column, n0: Column, ties: Column) -> Column:
    """Two-sided p of U, by the normal law with a correction for ties and one for continuity."""
    n1, n0 = n1.cast("double"), n0.cast("double")
    n = n1 + n0
    se = F.sqrt(n1 * n0 / 12.0 * (n + 1 - F.try_divide(ties, n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n0 - u) - n1 * n0 / 2.0 - 0.5, se)
    return F.least(F.lit(1.0), 2.0 * normal_tail(z))
