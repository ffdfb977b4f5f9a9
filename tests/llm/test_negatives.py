"""Hard negatives against a loop over all pairs."""

from __future__ import annotations

import math
import random

import pytest

from encore.llm import negatives


def brute(rows, every=50, positives=5, negatives=3):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x) for x in v)
        kept[i] = min((label, q), kept.get(i, (label, q)))
    out = set()
    for a, (label, q) in kept.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, p)) for i, (_, p) in kept.items() if len(p) == len(q)}
        order = lambda ids: sorted(ids, key=lambda i: (-score[i], i))
        for p in order([i for i in score if i != a and kept[i][0] == label])[:positives]:
            near = [i for i in score if kept[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, k, n, score[p], score[n]) for k, n in enumerate(order(near)[:negatives], 1)}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, label, v in rows], "vec_id long, embedding array<double>, label int, q string, block int")
    return {tuple(r) for r in negatives.hard_negatives(df, **more).collect()}


def made(rng, n, dim=8, labels=4):
    return [(k, rng.randrange(labels), [rng.gauss(0, 0.4) for _ in range(dim)]) for k in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_random(spark, seed):
    rows = made(random.Random(seed), 700)
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_digits_and_blocks(spark, monkeypatch):
    """Narrow digits, so several passes; small blocks, so each holds a few rows."""
    monkeypatch.setattr(negatives, "DIGIT_BITS", 3)
    monkeypatch.setattr(negatives, "FEW", 1)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 40)
    rows = made(random.Random(3), 600, dim=5)
    assert run(spark, rows) == brute(rows)


def test_ties_and_a_hot_vector(spark):
    rng = random.Random(4)
    rows = made(rng, 300)
    hot = [0.3] * 8
    rows += [(1000 + k, k % 2, hot) for k in range(300)] + [(2000 + k, 3, [0.27] * 8) for k in range(300)]
    assert run(spark, rows, every=100) == brute(rows, every=100)


def test_odd_rows(spark):
    rows = made(random.Random(6), 200)
    rows += [(None, 1, [0.1] * 8), (400, None, [0.1] * 8), (450, 1, None), (500, 1, [0.1, None] * 4), (550, 1, [math.nan] * 8), (600, 1, [math.inf] + [0.0] * 7)]
    rows += [(50, 3, [0.5] * 8), (50, 3, [0.5] * 8), (650, 2, []), (651, 2, []), (652, 1, []), (700, 1, [0.2] * 3), (701, 1, [0.2] * 3), (702, 0, [0.15] * 3), (750, 0, [0.0] * 8), (-50, 2, [0.4] * 8), (800, 1, [3e5, -2e5] * 4), (801, 1, [3e5, -2e5] * 4), (802, 0, [2.5e5, -2e5] * 4)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(r[0] == 700 for r in got) and any(r[0] == 800 for r in got) and any(r[0] == -50 for r in got)


def test_empty_and_alone(spark):
    assert run(spark, []) == set()
    assert run(spark, [(50, 1, [0.1, 0.2])]) == set()
    assert run(spark, [(50, 1, [0.1, 0.2]), (51, 1, [0.1, 0.2])]) == set()


def test_scores_beyond_63_bits_fail(spark):
    with pytest.raises(Exception, match="63 bits"):
        run(spark, [(50, 1, [1e15, 1e15]), (51, 1, [1e15, 1e15])])
