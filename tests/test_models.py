"""Boosting, folds, encoders, components and silhouettes against plain arithmetic."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from encore.operators import boosting, models


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=40)
    p = boosting.Boosting(trees=1, step=1.0, depth=1, least=5, share=1.0, l1=0.5, l2=1.0)
    model = boosting.fit_trees(x, y, np.ones((1, 40), bool), p)[0]
    pull = lambda g: math.copysign(max(abs(g) - 0.5, 0), g)
    part = lambda g: pull(g.sum()) ** 2 / (len(g) + 1)
    gain = {}
    for f in range(3):
        v = np.sort(x[:, f])
        for c in (v[1:] + v[:-1]) / 2:
            left = x[:, f] <= c
            if 5 <= left.sum() <= 35:
                g = y.mean() - y
                gain[f, c] = part(g[left]) + part(g[~left])
    (f, c), _ = max(gain.items(), key=lambda kv: kv[1])
    assert model["feature"][0, 0] == f and model["cut"][0, 0] == pytest.approx(c)
    left = x[:, f] <= c
    due = [y.mean() - pull((y.mean() - y)[left == side].sum()) / ((left == side).sum() + 1) for side in left]
    assert boosting.apply_trees(model, x) == pytest.approx(due)


@pytest.mark.parametrize("logistic", [False, True])
def test_folds_see_nothing_of_themselves(logistic):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    y = 2 * x[:, 0] + (x[:, 1] > 0)
    y = (y > 0.5).astype(float) if logistic else y
    fold = rng.integers(0, 5, 300)
    train = np.stack([fold != k for k in range(5)])
    p = boosting.Boosting(trees=60, step=0.1, logistic=logistic, l1=0.0)
    one = boosting.fit_trees(x, y, train, p)
    changed = np.where(fold == 2, 1 - y, y)
    two = boosting.fit_trees(x, changed, train, p)
    own = lambda m: boosting.apply_trees(m[2], x[fold == 2], logistic)
    assert (own(one) == own(two)).all()
    pred = np.concatenate([boosting.apply_trees(one[k], x[fold == k], logistic) for k in range(5)])
    truth = np.concatenate([y[fold == k] for k in range(5)])
    if logistic:
        assert ((pred > 0.5) == truth).mean() > 0.85 and 0 < pred.min() and pred.max() < 1
    else:
        assert 1 - ((pred - truth) ** 2).sum() / ((truth - truth.mean()) ** 2).sum() > 0.85


def test_fit_and_score_through_spark(spark):
    rng = np.random.default_rng(5)
    x, fold = rng.normal(size=(200, 2)), rng.integers(0, 3, 200)
    y = x[:, 0] - x[:, 1]
    x[::17, 1] = np.nan
    p = boosting.Boosting(trees=20, step=0.2, share=1.0)
    rows = [(fit, k, int(fold[k]), float(s * y[k]), x[k].tolist(), None) for fit, s in (("a", 1), ("b", -1)) for k in range(200)]
    df = spark.createDataFrame([*rows, ("a", 900, 0, None, [0.0, 0.0], None)], "fit string, key long, fold int, y double, x array<double>, own array<double>")
    fits = boosting.fit_folds(df, 3, p)
    got = {(r["fit"], r["key"]): r["predicted"] for r in boosting.score(df.select("fit", "key", "fold", "x"), fits, p).collect()}
    assert len(got) == 401
    for fit, s in (("a", 1), ("b", -1)):
        ms = boosting.fit_trees(x, s * y, np.stack([fold != k for k in range(3)]), p)
        for k in range(200):
            assert got[fit, k] == pytest.approx(boosting.apply_trees(ms[fold[k]], x[k : k + 1])[0])


def test_a_fold_of_its_own_value(spark):
    """The encoding that a fold's fit and its scores use is that fold's."""
    rng = random.Random(6)
    rows = [("f", k, k % 2, float(k % 7), [0.0], [rng.random(), float(k % 7)]) for k in range(120)]
    df = spark.createDataFrame(rows, "fit string, key long, fold int, y double, x array<double>, own array<double>")
    p = boosting.Boosting(trees=50, step=0.3, share=1.0, l1=0.0)
    fits = boosting.fit_folds(df, 2, p)
    scored = boosting.score(df.select("fit", "fold", "y", F.concat("x", F.array(F.element_at("own", F.col("fold") + 1))).alias("x")), fits, p)
    off = {r["fold"]: r["e"] for r in scored.groupBy("fold").agg(F.avg(F.abs(F.col("predicted") - F.col("y"))).alias("e")).collect()}
    assert off[1] < 0.3 < 1 < off[0]


def test_encoders_leave_their_fold_out(spark):
    rng = random.Random(7)
    songs = [(k, rng.choice(["a", "b", "c", None])) for k in range(80)] + [(80, "lone")]
    labels = {k: float(rng.randint(1, 5)) for k, _ in songs}
    df = spark.createDataFrame(songs, "song_id long, artist string")
    known = spark.createDataFrame([(k, a, labels[k]) for k, a in songs], "song_id long, artist string, label double")
    folds = {(r["rep"], r["song_id"]): r["fold"] for r in models.in_folds(known, 2, 4).collect()}
    for r in models.fold_encodings(df, known, 2, 4, 3.0).collect():
        rest = [(a, labels[k]) for k, a in songs if folds[r["rep"], k] != r["fold"]]
        g = sum(v for _, v in rest) / len(rest)
        own = [v for a, v in rest if a is not None and a == r["artist"]]
        assert r["mean_enc"] == pytest.approx(sum(own) / len(own) if own else g)
        assert r["shrink_enc"] == pytest.approx((sum(own) + 3 * g) / (len(own) + 3))


def test_encoder_comparison_tells_the_artist(spark):
    rng = random.Random(9)
    songs = [(k, f"a{k % 6}", rng.random(), rng.random()) for k in range(150)]
    df = spark.createDataFrame(songs, "song_id long, artist string, x double, z double")
    labels = spark.createDataFrame([(k, float(k % 6) + 0.1 * rng.random()) for k in range(0, 150, 2)], "song_id long, label double")
    got = {(r["feature_set"], r["encoder"]): r["r"] for r in models.encoder_comparison(df, labels, {"one": ["x"], "two": ["x", "z"]}, 2, 3, boosting.Boosting(trees=60, step=0.1)).collect()}
    assert set(got) == {(s, e) for s in ("one", "two") for e in ("mean", "shrink", "semi")}
    assert min(got.values()) > 0.8


def test_line_against_least_squares(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(120, 3))
    x[:, 2] = x[:, 0] + x[:, 1]  # says nothing new
    y, fold = x[:, 0] * 2 - x[:, 1] + 5 + rng.normal(size=120), rng.integers(0, 4, 120)
    df = spark.createDataFrame([(k, int(fold[k]), *map(float, x[k]), float(y[k])) for k in range(120)], "k long, fold int, a double, b double, c double, y double")
    got = {r["k"]: r["predicted"] for r in models.line_out_of_fold(df, ["a", "b", "c"], "y").collect()}
    for f in range(4):
        w = np.linalg.lstsq(np.c_[x, np.ones(120)][fold != f], y[fold != f], rcond=None)[0]
        for k in np.flatnonzero(fold == f):
            assert got[k] == pytest.approx(float(np.r_[x[k], 1] @ w), abs=1e-6)


def panel(spark, rows):
    return spark.createDataFrame([(k, k, 0, 0, 0, 0, 0, 0, 0, float(k % 40), 5, 100.0 + k, future, float(a)) for k, (future, a) in enumerate(rows)], "song_id long, T long, level long, c1 long, c2 long, c3 long, c4 long, slope long, accel long, dsl double, familiarity long, age double, future long, A double")


def test_revival_guards_and_gain(spark):
    few = models.revival(panel(spark, [(k % 2, 1) for k in range(50)]))
    assert few.count() == 0 and models.revival(panel(spark, [(0, 1)] * 80)).count() == 0
    rng = random.Random(11)
    rows = [(int(a > 2.5), a) for a in (rng.random() * 5 for _ in range(400))]
    got = {r["feature_set"]: r for r in models.revival(panel(spark, rows)).collect()}
    assert got["trajectory and A"]["auc"] > 0.95 > 0.65 > got["trajectory"]["auc"] and got["trajectory"]["n"] == 400 and got["trajectory"]["rho"] > 0.8


def test_components_against_numpy(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(60, 10)) @ rng.normal(size=(10, 10))
    songs = spark.createDataFrame([(k, f"s{k}") for k in range(65)], "song_id long, title string")
    vectors = spark.createDataFrame([(k, v[k].tolist()) for k in range(60)], "song_id long, v array<double>")
    whole = np.r_[v, np.repeat(v.mean(0)[None], 5, 0)]
    z = (whole - whole.mean(0)) / (whole.std(0) + 1e-9)
    _, _, w = np.linalg.svd(z, full_matrices=False)
    w = w[:3].T
    w = w * np.sign(w[np.abs(w).argmax(0), range(3)])
    got = {r["song_id"]: [r[f"audio_{i}"] for i in range(3)] for r in models.with_components(songs, vectors, 3).collect()}
    assert len(got) == 65
    for k in range(65):
        assert got[k] == pytest.approx((z[k] @ w).tolist(), abs=1e-6)


def test_silhouette_against_a_loop(spark):
    rng = random.Random(13)
    rows = [(k, [rng.gauss(k % 3, 0.7), rng.gauss(0, 0.7)], k % 3) for k in range(50)] + [(50, [9.0, 9.0], 7), (51, [0.0, 0.0], 0), (52, [0.0, 0.0], 0)]
    df = spark.createDataFrame([*rows, (None, [0.0, 0.0], 1), (60, None, 1), (61, [1.0, 1.0], None)], "id long, v array<double>, c int")
    got = {r["id"]: r["silhouette"] for r in models.silhouette(df, "id", "v", "c", block=7).collect()}
    due = {}
    for i, v, c in rows:
        mean = {}
        for d in {r[2] for r in rows}:
            own = [math.dist(v, w) for j, w, e in rows if e == d and j != i]
            if own:
                mean[d] = sum(own) / len(own)
        b = min(x for d, x in mean.items() if d != c)
        due[i] = 0.0 if c not in mean else (b - mean[c]) / max(b, mean[c])
    assert got == pytest.approx(due)
    assert [r["silhouette"] for r in models.silhouette(df.filter("c = 0"), "id", "v", "c").collect()] == [None] * 19


def test_songs_meet_all_models_where_they_are(spark):
    """Sums of what every model says, by artist, against a walk through each tree; songs stay one row each."""
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(90, 2)), rng.normal(size=90)
    x[::7, 1] = np.nan
    p = boosting.Boosting(trees=9, step=0.3, least=2)
    means = rng.normal(size=(5, 4))  # artists (the last is unknown) x repetitions and folds
    fits, models_of = [], {}
    for rep in range(2):
        for fold in range(2):
            m = boosting.fit_trees(np.c_[x, rng.normal(size=90)], y, np.ones((1, 90), bool), p)[0]
            models_of[rep, fold] = m
            fits.append((f"s:{rep}", fold, bytearray(boosting.packed(m))))
    songs = [(f"a{k % 5}" if k % 5 < 4 else None, float(x[k, 0]), None if np.isnan(x[k, 1]) else float(x[k, 1]), means[k % 5].tolist()) for k in range(90)]
    df = spark.createDataFrame(songs, "artist string, u double, v double, means array<double>")
    got = {(r["rep"], r["fold"], r["artist"]): (r["np"], r["sp"]) for r in models._guessed(df, spark.createDataFrame(fits, "fit string, fold int, model binary"), {"s": ["u", "v"]}, 2, p).collect()}
    assert len(got) == 20

    def walk(m, row):
        out = float(m["base"])
        for feature, cut, value in zip(m["feature"], m["cut"], m["value"]):
            at = 0
            for level in range(p.depth):
                k = 2**level - 1 + at
                at = 2 * at + int(feature[k] >= 0 and (np.isnan(row[feature[k]]) or row[feature[k]] > cut[k]))
            out += value[at]
        return out

    for (rep, fold, artist), (n, total) in got.items():
        a = 4 if artist is None else int(artist[1])
        own = [walk(models_of[rep, fold], [*x[k], means[a, rep * 2 + fold]]) for k in range(90) if k % 5 == a]
        assert n == len(own) and total == pytest.approx(sum(own))
