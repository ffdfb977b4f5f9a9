"""Affinity (how much a song is loved) and momentum (how much it is heard now)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.labels import severity, zone_label
from encore.functions.times import days_floor, week_key
from encore.operators import features

#: Weights of the parts.
AFFINITY = {"skip_quality": 0.30, "trajectory": 0.20, "play_depth": 0.20, "proactive": 0.15, "artist_familiarity": 0.15}
MOMENTUM = {"recency": 0.25, "recent_freq": 0.20, "artist_trend": 0.20, "momentum_delta": 0.35}


def weekly_trend(plays: DataFrame) -> DataFrame:
    """By artist: a week's plays of the last 28 days against the mean of weeks with plays, at most
    1; under 5 plays or 2 weeks it is 0.5."""
    rows = features.with_clock(plays.filter(F.col("artist").isNotNull()), plays)
    recent = F.count_if(F.col("ts") >= F.col("now") - F.expr("interval 28 days"))
    weeks = rows.groupBy("artist", week_key(F.col("ts")).alias("week")).agg(F.count("*").alias("n"), recent.alias("r"))
    out = weeks.groupBy("artist").agg(F.sum("n").alias("plays"), F.count("*").alias("weeks"), F.avg("n").alias("mean"), F.sum("r").alias("recent"))
    trend = F.least(F.lit(1.0), (F.col("recent") / 4.0) / F.col("mean"))
    return out.select("artist", F.when((F.col("plays") < 5) | (F.col("weeks") < 2), 0.5).otherwise(trend).alias("artist_trend"))


def scored(plays: DataFrame) -> DataFrame:
    """What `song_scores` reads of a log; it reads it several times, so stage a log that is costly."""
    return plays.select("song_id", "artist", "title", "ts", "tie", "is_skipped", "proactive_score")


def song_scores(plays: DataFrame) -> DataFrame:
    """Affinity, momentum and zone by song."""
    totals = features.song_totals(plays)
    halves = features.half_split_skip(plays)
    peak = totals.agg(F.max("total_plays").alias("max_plays"), F.count("*").alias("songs"), F.sum("total_plays").alias("rows"))
    span = plays.agg(F.greatest(days_floor(F.min("ts"), F.max("ts")), F.lit(1)).alias("span"))
    rows = totals.join(halves, "song_id", "left").join(features.artist_familiarity(plays).select("artist", "artist_familiarity"), "artist", "left").join(weekly_trend(plays), "artist", "left")
    rows = rows.crossJoin(F.broadcast(peak)).crossJoin(F.broadcast(span))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    c = F.col
    parts = {
        "skip_quality": 1.0 - c("skip_rate"),
        "trajectory": F.coalesce(clip(0.5 + c("first_half_skip") - c("second_half_skip")), F.lit(0.5)),
        "play_depth": F.log2(1.0 + c("total_plays")) / F.log2(1.0 + c("max_plays")),
        "proactive": F.coalesce(c("avg_proactive"), F.lit(0.0)),
        "artist_familiarity": F.coalesce(c("artist_familiarity"), F.lit(0.0)),
    }
    expected = c("rows") / c("span") * 30.0 / F.greatest(c("songs"), F.lit(1)) * 5.0
    ratio = c("recent_30d_plays") / (c("prev_60d_plays") / 2.0)
    moves = {
        "recency": F.exp(-F.greatest(F.lit(0), c("days_since_last") - 7) / 60.0),
        "recent_freq": F.least(F.lit(1.0), c("recent_30d_plays") / F.greatest(expected, F.lit(0.5))),
        "artist_trend": F.coalesce(c("artist_trend"), F.lit(0.5)),
        "momentum_delta": F.when(c("prev_60d_plays") > 0, clip((ratio - 0.5) / 1.5)).when(c("recent_30d_plays") > 0, 1.0).otherwise(0.3),
    }
    total = lambda w, p: F.round(clip(sum((w[k] * p[k] for k in w), F.lit(0.0))), 3)
    zone = zone_label(c("first_half_skip"), c("second_half_skip"), c("skip_rate"), c("total_plays"))
    return rows.select("song_id", "artist", "title", "total_plays", total(AFFINITY, parts).alias("affinity"), total(MOMENTUM, moves).alias("momentum"), zone.alias("zone"))


def growth_signals(plays: DataFrame, days_back: int = 14, least: int = 5, share: float = 0.3) -> DataFrame:
    """Artists whose most played song of the last days stands out: at least `least` plays there, and
    `share` of all its plays."""
    recent = features.with_clock(plays.filter(F.col("artist").isNotNull()), plays).filter(F.col("ts") >= F.col("now") - F.expr(f"interval {days_back} days"))
    counts = recent.groupBy("artist", "song_id").agg(F.count("*").alias("recent"))
    top = counts.withColumn("rn", F.row_number().over(Window.partitionBy("artist").orderBy(F.desc("recent"), "song_id"))).filter("rn = 1").drop("rn")
    history = plays.groupBy("song_id").agg(F.count("*").alias("history"))
    out = top.join(history, "song_id").withColumn("ratio", F.col("recent") / F.col("history"))
    return out.filter((F.col("recent") >= least) & (F.col("ratio") >= share)).select("artist", F.col("song_id").alias("trigger_song_id"), "recent", "history", "ratio")


def decline_series(plays: DataFrame, least: int = 15, weeks: int = 6) -> DataFrame:
    """By artist: plays by week, means of both halves of the weeks, slope, what is left, severity."""
    weekly = plays.filter(F.col("artist").isNotNull()).groupBy("artist", week_key(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("artist")
    rows = weekly.select("artist", "n", F.row_number().over(own.orderBy("week")).alias("rn"), F.count("*").over(own).alias("w"), F.sum("n").over(own).alias("plays"))
    first = F.expr("rn <= w div 2")
    out = rows.filter((F.col("plays") >= least) & (F.col("w") >= weeks)).groupBy("artist").agg(
        F.count("*").alias("weeks"), F.avg(F.when(first, F.col("n"))).alias("first_mean"), F.avg(F.when(~first, F.col("n"))).alias("second_mean"), F.regr_slope(F.col("n").cast("double"), (F.col("rn") - 1).cast("double")).alias("slope")
    )
    out = out.filter(F.col("first_mean") >= 1).withColumn("ratio", F.col("second_mean") / F.greatest("first_mean", F.lit(0.1)))
    return out.withColumn("severity", severity(F.col("ratio"), F.col("slope")))


def decline_signals(plays: DataFrame) -> DataFrame:
    return decline_series(plays).filter(F.col("severity").isNotNull())


def decline_correction(songs: DataFrame, signals: DataFrame) -> DataFrame:
    """`songs` (artist, temperature, skip_rate) with the temperature a declining artist leaves."""
    rows = songs.join(signals.select("artist", "severity"), "artist", "left")
    t = F.col("temperature")
    out = F.when((F.col("severity") == "critical") & (t == "Warm"), "Cool").when((F.col("severity") == "critical") & (t == "Cool") & (F.col("skip_rate") > 0.15), "Frozen")
    return rows.withColumn("corrected", out.when((F.col("severity") == "severe") & (t == "Warm") & (F.col("skip_rate") > 0.20), "Cool").otherwise(t))
