"""Tail probabilities, ranks and quantiles against plain arithmetic."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from encore.functions import stats
from encore.operators import lifecycle, order


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_normal_tail(spark):
    z = [-6.0, -1.5, 0.0, 0.3, 1.0, 1.96, 3.0, 5.0, 9.0]
    got = one(spark, **{f"p{i}": stats.normal_tail(F.lit(v)) for i, v in enumerate(z)})
    for v, p in zip(z, got, strict=True):
        due = math.erfc(v / math.sqrt(2)) / 2
        assert p == pytest.approx(due, rel=2e-7, abs=1e-12)


def student(t: float, n: float) -> float:
    """Two-sided, by Simpson's rule over the angle."""
    steps = 20001
    a = np.linspace(math.atan(abs(t) / math.sqrt(n)), math.pi / 2, steps)
    y = np.cos(a) ** (n - 1)
    area = (a[1] - a[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return 2 * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi) * area


def test_student(spark):
    cases = [(12.706204736432095, 1), (2.2281388519649385, 10), (2.0422724563012373, 30), (0.1, 3), (1.5, 7), (4.0, 200), (0.0, 5), (1.9623390808264078, 1000), (-3.0, 9999), (2.5, 10_001), (1.0, 100_000)]
    got = one(spark, **{f"p{i}": stats.student_two_sided(F.lit(float(t)), F.lit(float(n))) for i, (t, n) in enumerate(cases)})
    for (t, n), p in zip(cases, got, strict=True):
        assert p == pytest.approx(student(t, n), abs=1e-6), (t, n)
    assert [got[i] for i in (0, 1, 2, 7)] == pytest.approx([0.05] * 4, abs=1e-6)  # tabulated


def test_spearman_p(spark):
    got = one(spark, a=stats.spearman_p(F.lit(0.8), F.lit(10)), b=stats.spearman_p(F.lit(1.0), F.lit(9)), c=stats.spearman_p(F.lit(0.5), F.lit(2)), d=stats.spearman_p(F.lit(-0.8), F.lit(10)))
    assert got["a"] == pytest.approx(student(0.8 * math.sqrt(8 / 0.36), 8), abs=1e-7) and got["d"] == pytest.approx(got["a"]) and got["b"] == 0 and got["c"] is None


def test_wilcoxon_and_mann_whitney(spark):
    d = [float(x) for x in (6, 8, 14, 16, 23, 24, 28, 29, 41, -48, 49, 56, 60, -67, 75)]
    got = lifecycle.wilcoxon(spark.createDataFrame([(x,) for x in d], "v double"), "v").first()
    assert got["W"] == 24 and got["p"] == pytest.approx(math.erfc((60 - 24) / math.sqrt(15 * 16 * 31 / 24) / math.sqrt(2)), abs=1e-6)
    rows = [(float(x), True) for x in (19, 22, 16, 29, 24)] + [(float(x), False) for x in (20, 11, 17, 12)]
    got = lifecycle.mann_whitney(spark.createDataFrame(rows, "v double, g boolean"), "v", "g").first()
    assert got["U"] == 17 and got["p"] == pytest.approx(0.11134688653314041, abs=1e-6)
    tied = [(1.0, True)] * 6 + [(2.0, True)] * 4 + [(1.0, False)] * 2 + [(2.0, False)] * 9
    got = lifecycle.mann_whitney(spark.createDataFrame(tied, "v double, g boolean"), "v", "g").first()
    n1, n0, k = 10, 11, (8, 13)
    se = math.sqrt(n1 * n0 / 12 * (22 - sum(x**3 - x for x in k) / (21 * 20)))
    u = max(got["U"], n1 * n0 - got["U"])
    assert got["p"] == pytest.approx(math.erfc((u - n1 * n0 / 2 - 0.5) / se / math.sqrt(2)), abs=1e-6)


def test_quantiles_and_ranks(spark):
    rng = random.Random(8)
    for values in ([rng.choice([1.5, 2.0, 7.0, rng.random() * 10]) for _ in range(400)], [3.0], [4.0, 4.0, 4.0], [float(k) for k in range(11)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
        got = {r["share"]: r["q"] for r in order.quantiles(df, "v", shares).collect()}
        assert [got[s] for s in shares] == pytest.approx([float(np.quantile(values, s)) for s in shares])
        ranks = {(r["v"], r["r"], r["k"]) for r in order.overall_rank(df.filter("v is not null"), "v", "r", "k").collect()}
        assert ranks == {(v, sum(x < v for x in values) + (values.count(v) + 1) / 2, values.count(v)) for v in values}
    empty = spark.createDataFrame([], "v double")
    assert [r["q"] for r in order.quantiles(empty, "v", [0.5]).collect()] == [None]


def test_holdout_groups_on_borders(spark):
    held = spark.createDataFrame([(k, 10, float(k), k * 2) for k in range(5)] + [(9, 10, None, 4)], "song_id long, n long, rho double, future_plays long")
    got = lifecycle.holdout_groups(held).first()
    assert (got["n1"], got["n0"], got["mean1"], got["mean0"], got["auc"]) == (2, 2, 7.0, 1.0, 1.0)
