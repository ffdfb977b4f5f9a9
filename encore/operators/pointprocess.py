"""Weibull life cycles: plays of a song as a point process with intensity A f(t; k, tau).

For given k and tau the likelihood is largest at A = n / F(T), so two parameters are searched: a
log-spaced grid over both, then finer grids around the best. Songs are independent; each is one row
with its sorted plays, and the grids of many songs are searched at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.times import days
from encore.operators import lifecycle, order
from encore.staging import stage


def log_likelihood(t: np.ndarray, horizon: float, k: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Up to constants, for every pair of the broadcast k and tau."""
    with np.errstate(all="ignore"):
        log_t = np.log(t)
        s1, top = log_t.sum(), log_t.max()
        powers = np.stack([np.exp(x * (log_t - top)).sum() for x in k.ravel()]).reshape(k.shape)  # once for each k
        s2 = powers * np.exp(k * (top - np.log(tau)))
        reach = -np.expm1(-((horizon / tau) ** k))
        out = len(t) * (np.log(k) - k * np.log(tau)) + (k - 1) * s1 - s2 - len(t) * np.log(reach)
    return np.where(reach > 1e-12, out, -1e18)


def fit_weibull(t: np.ndarray, horizon: float, shape: float | None = None, rounds: int = 6) -> tuple[float, float, float]:
    """(k, tau, log-likelihood); with `shape`, only tau is searched."""
    lk = (np.log(0.2), np.log(5.0))
    lt = (np.log(max(t.min(), 1e-3) / 2), np.log(100 * horizon))
    best = (1.0, horizon, -np.inf)
    for _ in range(rounds):
        ks = np.array([shape]) if shape else np.exp(np.linspace(*lk, 13))
        ts = np.exp(np.linspace(*lt, 25))
        ll = log_likelihood(t, horizon, ks[:, None], ts[None, :])
        i, j = np.unravel_index(np.argmax(ll), ll.shape)
        if ll[i, j] > best[2]:
            best = (float(ks[i]), float(ts[j]), float(ll[i, j]))
        dk, dt = (lk[1] - lk[0]) / 12 * 1.2, (lt[1] - lt[0]) / 24 * 1.2
        lk = (max(np.log(0.2), np.log(best[0]) - dk), min(np.log(5.0), np.log(best[0]) + dk))
        lt = (np.log(best[1]) - dt, np.log(best[1]) + dt)
    return best


def fit_many(songs: list[np.ndarray], horizons: np.ndarray, shape: float | None = None, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`fit_weibull` of every song (sorted times), side by side."""
    n = np.array([len(t) for t in songs])
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    log_t = np.log(np.concatenate(songs))
    s1, top = np.add.reduceat(log_t, starts), np.maximum.reduceat(log_t, starts)
    gap = log_t - np.repeat(top, n)
    low, high = np.log(0.2), np.log(5.0)
    k_lo, k_hi = np.full(len(n), low), np.full(len(n), high)
    t_lo, t_hi = np.log(np.maximum(np.array([t[0] for t in songs]), 1e-3) / 2), np.log(100 * horizons)
    k, tau, best = np.ones(len(n)), np.array(horizons, float), np.full(len(n), -np.inf)
    all_songs = np.arange(len(n))
    powers = None
    for _ in range(rounds):
        ks = np.full((len(n), 1), shape) if shape else np.exp(np.linspace(k_lo, k_hi, 13, axis=1))
        ts = np.exp(np.linspace(t_lo, t_hi, 25, axis=1))
        if powers is None or not shape:
            powers = np.stack([np.add.reduceat(np.exp(np.repeat(ks[:, j], n) * gap), starts) for j in range(ks.shape[1])], 1)
        a, b, m = ks[:, :, None], ts[:, None, :], n[:, None, None]
        with np.errstate(all="ignore"):
            reach = -np.expm1(-((horizons[:, None, None] / b) ** a))
            ll = m * (np.log(a) - a * np.log(b)) + (a - 1) * s1[:, None, None] - powers[:, :, None] * np.exp(a * (top[:, None, None] - np.log(b))) - m * np.log(reach)
        ll = np.where(reach > 1e-12, ll, -1e18).reshape(len(n), -1)
        at = ll.argmax(1)
        found = ll[all_songs, at]
        better = found > best
        k, tau, best = np.where(better, ks[all_songs, at // 25], k), np.where(better, ts[all_songs, at % 25], tau), np.where(better, found, best)
        dk, dt = (k_hi - k_lo) / 12 * 1.2, (t_hi - t_lo) / 24 * 1.2
        k_lo, k_hi = np.maximum(low, np.log(k) - dk), np.minimum(high, np.log(k) + dk)
        t_lo, t_hi = np.log(tau) - dt, np.log(tau) + dt
    return k, tau, best


def by_songs(times: DataFrame, f: Callable[[list, list[np.ndarray], np.ndarray], list[tuple]], schema: str, most: int = 50_000) -> DataFrame:
    """Rows that `f` makes of ids, sorted times and horizons of some songs, at most `most` plays at
    once (or one song)."""
    rows = times.groupBy("song_id").agg(F.sort_array(F.collect_list("t")).alias("t"), F.max("horizon").alias("horizon"))
    kinds = times.sparkSession.createDataFrame([], schema).schema
    out = pa.schema([(c.name, {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[c.dataType.simpleString()]) for c in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("t")
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            songs = np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])
            ids, horizons = batch.column("song_id").to_pylist(), batch.column("horizon").to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, min(lo + 500, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right"))))
                found = f(ids[lo:hi], songs[lo:hi], horizons[lo:hi])
                columns = zip(*found, strict=True) if found else [[] for _ in out]
                yield pa.RecordBatch.from_arrays([pa.array([x.item() if hasattr(x, "item") else x for x in c], f.type) for c, f in zip(columns, out, strict=True)], schema=out)
                lo = hi

    return rows.mapInArrow(run, schema)


def event_times(plays: DataFrame, clock: str = "days", least: int = 16, least_days: float = 7.0) -> DataFrame:
    """(song_id, t, horizon): time since a song's first play, plus 1, in days or in plays of the log;
    the horizon runs to the log's end."""
    rows = plays.join(lifecycle.life_span(plays, least, least_days).select("song_id"), "song_id", "left_semi")
    own = Window.partitionBy("song_id")
    if clock == "days":
        end = plays.agg(F.max("ts").alias("end"))
        rows = rows.crossJoin(F.broadcast(end)).select("song_id", (days(F.min("ts").over(own), F.col("ts")) + 1).alias("t"), (days(F.min("ts").over(own), F.col("end")) + 1).alias("horizon"))
        return rows
    counted = lifecycle.play_ordinal(plays.select("song_id", "ts", "tie")).join(rows.select("song_id").distinct(), "song_id", "left_semi")
    end = plays.agg((F.count("*") - 1).alias("end"))
    first = F.min("gidx").over(own)
    return counted.crossJoin(F.broadcast(end)).select("song_id", (F.col("gidx") - first + 1).cast("double").alias("t"), (F.col("end") - first + 1).cast("double").alias("horizon"))


FIT = "song_id long, n long, horizon double, k double, tau double, A double, ll double, still_open boolean"


def fit_songs(times: DataFrame, shape: float | None = None) -> DataFrame:
    """One fit by song; `still_open` marks a tau far beyond what was observed (over 5 horizons)."""

    def run(ids: list, songs: list[np.ndarray], horizons: np.ndarray) -> list[tuple]:
        fits = zip(ids, songs, horizons, *fit_many(songs, horizons, shape), strict=True)
        return [(i, len(t), h, k, tau, len(t) / max(-np.expm1(-((h / tau) ** k)), 1e-12), ll, tau > 5 * h) for i, t, h, k, tau, ll in fits]

    return by_songs(times, run, FIT)


def shared_shape(times: DataFrame, low: float = 0.2, high: float = 5.0, points: int = 17) -> DataFrame:
    """(k, ll): the log-likelihood of all songs if they share k, each with its own tau. A log-spaced
    grid of k, all in one pass, then as many points between the best one's neighbours."""

    def tried(shapes: list[float]) -> DataFrame:
        def run(ids: list, songs: list[np.ndarray], horizons: np.ndarray) -> list[tuple]:
            return [(k, fit_many(songs, horizons, k, 4)[2].sum()) for k in shapes]

        return stage(by_songs(times, run, "k double, ll double").groupBy("k").agg(F.sum("ll").alias("ll")), "shapes")

    coarse = tried([float(x) for x in np.geomspace(low, high, points)])
    best = coarse.orderBy(F.desc("ll"), "k").limit(1).collect()
    step = (high / low) ** (1 / (points - 1))
    fine = [float(x) for r in best for x in np.geomspace(max(low, r["k"] / step), min(high, r["k"] * step), points)]
    return coarse.unionByName(tried(fine)) if fine else coarse


def compare_shapes(times: DataFrame) -> DataFrame:
    """(model, ll, parameters, bic) of a shape for each song and of one shape for all."""
    own = fit_songs(times).agg(F.sum("ll").alias("ll"), F.count("*").alias("songs"), F.sum("n").alias("events"))
    one = shared_shape(times).agg(F.max("ll").alias("ll1"))
    both = own.crossJoin(one)
    rows = F.explode(F.array(F.struct(F.lit("own shape").alias("model"), F.col("ll").alias("ll"), (3 * F.col("songs")).alias("parameters")), F.struct(F.lit("one shape").alias("model"), F.col("ll1").alias("ll"), (2 * F.col("songs") + 1).alias("parameters"))))
    return both.select("events", rows.alias("r")).select("r.model", "r.ll", "r.parameters", (F.col("r.parameters") * F.log("events") - 2 * F.col("r.ll")).alias("bic"))


def halves(times: DataFrame, at: float = 0.5, least: int = 8) -> DataFrame:
    """(song_id, n, past, future): plays up to a part of the song's horizon and after it; songs of
    at least `least` plays in the first part."""
    cut = 1 + at * (F.col("horizon") - 1)
    return times.groupBy("song_id").agg(F.count("*").alias("n"), F.count_if(F.col("t") <= cut).alias("past"), F.count_if(F.col("t") > cut).alias("future")).filter(F.col("past") >= least)


def with_baselines(songs: DataFrame) -> DataFrame:
    """`songs` (past, future) with what the plays so far, and those by the songs' median ratio of
    later to earlier plays, foretell."""
    ratio = order.quantiles(songs.select((F.col("future") / F.greatest("past", F.lit(1))).alias("r")), "r", [0.5]).select(F.col("q").alias("ratio"))
    return songs.crossJoin(F.broadcast(ratio)).select("*", F.col("past").cast("double").alias("persistence"), (F.col("past") * F.col("ratio")).alias("population")).drop("ratio")


def forecast(times: DataFrame, at: float = 0.5, least: int = 8) -> DataFrame:
    """(song_id, past, future, predicted): a fit up to a part of the horizon foretells the rest; at
    most five times all the song's plays."""

    def run(ids: list, songs: list[np.ndarray], horizons: np.ndarray) -> list[tuple]:
        cuts = 1 + at * (horizons - 1)
        pasts = [t[t <= d] for t, d in zip(songs, cuts, strict=True)]
        some = [i for i, past in enumerate(pasts) if len(past) >= least]
        out = []
        for i, k, tau, _ in zip(some, *fit_many([pasts[i] for i in some], cuts[some]), strict=True) if some else ():
            cdf = lambda x: -np.expm1(-((x / tau) ** k))  # noqa: E731, B023
            past, all_plays = len(pasts[i]), len(songs[i])
            more = past / max(cdf(cuts[i]), 1e-12) * (cdf(horizons[i]) - cdf(cuts[i]))
            out.append((ids[i], past, all_plays - past, min(more, 5.0 * all_plays)))
        return out

    return by_songs(times, run, "song_id long, past long, future long, predicted double")


def errors_of(rows: DataFrame, predictors: list[str], actual: str = "future") -> DataFrame:
    """(predictor, n, mae, median_error, rho) of each predictor's column against what came."""
    out = None
    for name in predictors:
        one = rows.select(F.col(name).cast("double").alias("x"), F.col(actual).cast("double").alias("y")).withColumn("e", F.abs(F.col("x") - F.col("y")))
        middle = order.quantiles(one, "e", [0.5]).select(F.col("q").alias("median_error"))
        rho = lifecycle.spearman(one, "x", "y", []).select("rho")
        found = one.agg(F.count("*").alias("n"), F.avg("e").alias("mae")).crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(rho)).select(F.lit(name).alias("predictor"), "n", "mae", "median_error", "rho")
        out = found if out is None else out.unionByName(found)
    return out


def forecast_report(times: DataFrame, at: float = 0.5, least: int = 8) -> DataFrame:
    """Errors of three ways to foretell a song's later plays: as many as so far, those by the songs'
    median ratio, and the fit of the song's first part."""
    times = stage(times, "times")
    rows = stage(with_baselines(halves(times, at, least)).join(forecast(times, at, least).select("song_id", F.col("predicted").alias("weibull")), "song_id"), "forecasts")
    return errors_of(rows, ["persistence", "population", "weibull"])


def tau_summary(fits: DataFrame) -> DataFrame:
    """(songs, open_share, p25, median, p75, iqr): how many songs' tau lies beyond what was observed,
    and the quartiles of tau of the others."""
    fits = stage(fits.select("tau", "still_open"), "fits")
    q = order.quantiles(fits.filter("not still_open"), "tau", [0.25, 0.5, 0.75])
    at = lambda x: F.max(F.when(F.col("share") == x, F.col("q")))
    middle = q.agg(at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"))
    return fits.agg(F.count("*").alias("songs"), F.avg(F.col("still_open").cast("double")).alias("open_share")).crossJoin(F.broadcast(middle)).withColumn("iqr", F.col("p75") - F.col("p25"))


def tau_life_span(fits: DataFrame, plays: DataFrame) -> DataFrame:
    """(n, rho, p): the rank correlation of tau and the days from first to last play, over songs
    whose tau was observed. Near 1, dividing times by the life span divides by the answer."""
    spans = lifecycle.life_span(plays).select("song_id", days(F.col("t0"), F.col("tl")).alias("span"))
    return lifecycle.spearman(fits.filter("not still_open").join(spans, "song_id"), "tau", "span", []).select("n", "rho", "p")


def identifiability(times: DataFrame, parts: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9), least: int = 30) -> DataFrame:
    """(part, songs, median_error): how far tau from a song's first events is from that of all."""

    def run(ids: list, songs: list[np.ndarray], horizons: np.ndarray) -> list[tuple]:
        some = [i for i, t in enumerate(songs) if len(t) >= least]
        if not some:
            return []
        whole = fit_many([songs[i] for i in some], horizons[some])[1]
        rows = []
        for f in parts:
            first = [songs[i][: max(int(len(songs[i]) * f), 8)] for i in some]
            rows += [(f, abs(tau / w - 1)) for tau, w in zip(fit_many(first, np.array([t[-1] for t in first]))[1], whole, strict=True)]
        return rows

    errors = by_songs(times, run, "part double, error double")
    return errors.groupBy("part").agg(F.count("*").alias("songs"), F.median("error").alias("median_error"))
