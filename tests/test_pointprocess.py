"""Which songs the point-process queries take."""

from __future__ import annotations

import numpy as np
import pytest

from encore.operators import pointprocess
from encore.operators.pointprocess import fit_weibull, log_likelihood
from encore.plans import catalog
from encore.sources.adapters import plays_d


def test_songs_from_16_plays_over_a_week_are_fitted(spark, sf_dir):
    rows = [(r["song_id"], r["ts"]) for r in plays_d(spark, sf_dir).select("song_id", "ts").collect()]
    by: dict[int, list] = {}
    for song, ts in rows:
        by.setdefault(song, []).append(ts)
    due = {s: len(t) for s, t in by.items() if len(t) >= 16 and (max(t) - min(t)).total_seconds() >= 7 * 86400}
    assert any(n < 30 for n in due.values())
    for clock in ("days", "plays"):
        assert {r["song_id"]: r["count"] for r in catalog._times(spark, sf_dir, clock).groupBy("song_id").count().collect()} == due
    assert {r["song_id"]: r["n"] for r in catalog.weibull_fit(spark, sf_dir).collect()} == due
    # the 30-play rule of the prefix refits stays their own
    assert {r["songs"] for r in catalog.tau_identifiability(spark, sf_dir).collect()} == {sum(n >= 30 for n in due.values())}


def simulated(rng, n, k, tau, horizon):
    """n events of the intensity A f(t; k, tau) seen up to a horizon."""
    u = rng.random(n) * -np.expm1(-((horizon / tau) ** k))
    return np.sort(tau * (-np.log1p(-u)) ** (1 / k))


@pytest.mark.parametrize(("k", "tau"), [(0.6, 40.0), (1.0, 100.0), (1.8, 60.0)])
def test_shape_and_scale_are_found_again(k, tau):
    rng = np.random.default_rng(1)
    t = simulated(rng, 4000, k, tau, 300.0)
    got = fit_weibull(t, 300.0)
    assert got[0] == pytest.approx(k, rel=0.1) and got[1] == pytest.approx(tau, rel=0.12)
    assert got[2] >= log_likelihood(t, 300.0, np.array([k]), np.array([tau]))[0] - 1e-6


def test_fit_is_the_best_of_a_fine_grid():
    rng = np.random.default_rng(2)
    for n in (20, 60):
        t = simulated(rng, n, 1.2, 80.0, 200.0)
        ks, taus = np.exp(np.linspace(np.log(0.2), np.log(5), 300)), np.exp(np.linspace(np.log(1), np.log(20000), 400))
        best = max(log_likelihood(t, 200.0, np.full(len(taus), x), taus).max() for x in ks)
        assert fit_weibull(t, 200.0)[2] >= best - 1e-3


def test_forecast_report_by_hand(spark):
    rng = np.random.default_rng(3)
    songs = {s: simulated(rng, 30, 1.0, 60.0, 200.0) for s in range(12)} | {50: np.linspace(150, 199, 9)}
    df = spark.createDataFrame([(s, float(t), 200.0) for s, ts in songs.items() for t in ts], "song_id long, t double, horizon double")
    cut = 1 + 0.5 * 199
    halves = {s: (int((t <= cut).sum()), int((t > cut).sum())) for s, t in songs.items() if (t <= cut).sum() >= 8}
    assert 50 not in halves
    ratio = np.median([f / p for p, f in halves.values()])
    got = {r["predictor"]: r for r in pointprocess.forecast_report(df).collect()}
    for name, of in (("persistence", lambda p: p), ("population", lambda p: p * ratio)):
        off = [abs(of(p) - f) for p, f in halves.values()]
        assert (got[name]["n"], got[name]["mae"], got[name]["median_error"]) == (len(halves), pytest.approx(np.mean(off)), pytest.approx(np.median(off)))
    assert got["weibull"]["mae"] < got["persistence"]["mae"]
    assert all(r["predicted"] <= 5 * (r["past"] + r["future"]) for r in pointprocess.forecast(df).collect())
