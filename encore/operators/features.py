"""Aggregates of a play log: by song, by artist, over all.

A log has song_id, title, artist, ts, skip_type, is_skipped, is_proactive, proactive_score and tie (a
total order among plays of one moment). Plays without a song or an artist belong to no group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.labels import time_of_day
from encore.functions.times import days, days_floor
from encore.operators.order import quantiles


def completed(plays: DataFrame) -> DataFrame:
    """Plays to the end; an unknown skip is none of them."""
    return plays.filter(F.col("skip_type") == 0)


def with_clock(rows: DataFrame, plays: DataFrame, name: str = "now") -> DataFrame:
    """`rows` beside one value, the last moment of `plays`. One row, so sent to all."""
    return rows.crossJoin(F.broadcast(plays.agg(F.max("ts").alias(name))))


def _mean(test: Column) -> Column:
    """Share of rows where the test holds; unknown counts as not."""
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def song_features(plays: DataFrame, least: int = 5) -> DataFrame:
    """Behaviour by song over all plays, songs of at least `least`."""
    plays = plays.filter(F.col("song_id").isNotNull())
    order = F.struct("ts", "tie")
    return (
        plays.groupBy("song_id")
        .agg(
            F.min_by("artist", order).alias("artist"), F.min_by("title", order).alias("title"), F.count("*").alias("plays"), F.count_if(F.col("skip_type") == 0).alias("completed_plays"),
            _mean(F.col("skip_type") == 0).alias("completion_rate"), _mean(F.col("skip_type") == 2).alias("immediate_skip_rate"), _mean(F.col("skip_type") == 1).alias("sample_skip_rate"),
            F.avg("is_proactive").alias("proactive_rate"),
        )
        .filter(F.col("plays") >= least)
        .drop("plays")
    )


def song_rates(plays: DataFrame, flags: list[str], least: int = 5) -> DataFrame:
    """(song_id, *flags): the mean of each 0/1 column by song, unknown values left out; songs of at
    least `least` plays."""
    rows = plays.filter(F.col("song_id").isNotNull()).groupBy("song_id").agg(F.count("*").alias("__n"), *(F.avg(c).alias(c) for c in flags))
    return rows.filter(F.col("__n") >= least).drop("__n")


def song_intensity(plays: DataFrame, least: int = 5, half_life: float = 30.0) -> DataFrame:
    """R (plays to the end, halved every `half_life` days), days since the last, plays of 28 days,
    plays in all; the clock is the last play to the end."""
    done = completed(plays).filter(F.col("song_id").isNotNull())
    age = days(F.col("ts"), F.col("now"))
    return (
        with_clock(done, done).groupBy("song_id")
        .agg(F.sum(F.pow(F.lit(0.5), age / half_life)).alias("R"), F.min(age).alias("dsl"), F.count_if(age <= 28).alias("level28"), F.count("*").alias("familiarity"))
        .filter(F.col("familiarity") >= least)
    )


def artist_stats(plays: DataFrame) -> DataFrame:
    """Breadth, volume, span and recency by artist; the clock is the last play."""
    rows = with_clock(plays.filter(F.col("artist").isNotNull()), plays)
    recent = F.col("ts") >= F.col("now") - F.expr("interval 30 days")
    stats = rows.groupBy("artist").agg(F.count_distinct("song_id").alias("unique_songs"), F.count("*").alias("total_plays"), F.count_if(recent).alias("recent_plays_30d"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.first("now").alias("now"))
    span = F.greatest(days_floor(F.col("first"), F.col("last")), F.lit(1))
    return stats.select("artist", "unique_songs", "total_plays", "recent_plays_30d", span.alias("listening_span_days"), (F.col("total_plays") / span).alias("play_density"), days_floor(F.col("last"), F.col("now")).alias("days_since_last"))


def song_totals(plays: DataFrame) -> DataFrame:
    """Plays, skips, recency and two recent windows by song."""
    rows = with_clock(plays.filter(F.col("song_id").isNotNull()), plays)
    back = lambda d: F.col("ts") >= F.col("now") - F.expr(f"interval {d} days")
    order = F.struct("ts", "tie")
    totals = rows.groupBy("song_id").agg(
        F.min_by("artist", order).alias("artist"), F.min_by("title", order).alias("title"), F.count("*").alias("total_plays"), F.sum("is_skipped").alias("skips"), F.avg("is_skipped").alias("skip_rate"),
        F.max("ts").alias("last"), F.count_if(back(30)).alias("recent_30d_plays"), F.count_if(back(90) & ~back(30)).alias("prev_60d_plays"), F.avg("proactive_score").alias("avg_proactive"), F.first("now").alias("now"),
    )
    return totals.withColumn("days_since_last", days_floor(F.col("last"), F.col("now"))).drop("last", "now")


def half_split_skip(plays: DataFrame, least: int = 3) -> DataFrame:
    """Skip rates of the first and the second half of a song's plays in order."""
    own = Window.partitionBy("song_id")
    rows = plays.filter(F.col("song_id").isNotNull()).select("song_id", "is_skipped", F.row_number().over(own.orderBy("ts", "tie")).alias("rn"), F.count("*").over(own).alias("n"))
    first = F.expr("rn <= n div 2")
    return rows.filter(F.col("n") >= least).groupBy("song_id").agg(F.avg(F.when(first, F.col("is_skipped"))).alias("first_half_skip"), F.avg(F.when(~first, F.col("is_skipped"))).alias("second_half_skip"))


def peak_time(plays: DataFrame) -> DataFrame:
    """The time of day with most plays by song; ties go to the first name."""
    slots = plays.filter(F.col("song_id").isNotNull()).groupBy("song_id", time_of_day(F.hour("ts")).alias("slot")).agg(F.count("*").alias("n"))
    return slots.groupBy("song_id").agg(F.min_by("slot", F.struct(-F.col("n"), "slot")).alias("peak_time_of_day"))


def modal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value by key; ties go to the least value."""
    counts = rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value))


def artist_familiarity(plays: DataFrame, known: int = 3) -> DataFrame:
    """By artist: songs, songs of at least `known` plays, and their share (at most 1)."""
    songs = plays.filter(F.col("artist").isNotNull() & F.col("song_id").isNotNull()).groupBy("artist", "song_id").agg(F.count("*").alias("n"))
    out = songs.groupBy("artist").agg(F.count("*").alias("songs"), F.count_if(F.col("n") >= known).alias("known"))
    return out.withColumn("artist_familiarity", F.least(F.lit(1.0), F.col("known") / F.greatest("songs", F.lit(1))))


def profile(plays: DataFrame) -> DataFrame:
    """Rows, songs, artists and the range of dates."""
    return plays.agg(F.count("*").alias("n_rows"), F.count_distinct("song_id").alias("n_songs"), F.count_distinct("artist").alias("n_artists"), F.min(F.to_date("ts")).cast("string").alias("first_day"), F.max(F.to_date("ts")).cast("string").alias("last_day"))


def coverage(songs: DataFrame, scored: DataFrame, value: str) -> DataFrame:
    """(songs, scored, share): how many distinct songs there are, and how many of them `scored`
    (song_id, value) knows a value of."""
    known = scored.filter(F.col(value).isNotNull()).select("song_id").distinct().withColumn("__known", F.lit(1))
    rows = songs.filter(F.col("song_id").isNotNull()).select("song_id").distinct().join(known, "song_id", "left")
    return rows.agg(F.count("*").alias("songs"), F.count("__known").alias("scored"), F.try_divide(F.count("__known"), F.count("*")).alias("share"))


def active_artists(plays: DataFrame, days_back: int = 90, least: int = 10) -> DataFrame:
    """Artists with at least `least` plays in the last days."""
    recent = with_clock(plays.filter(F.col("artist").isNotNull()), plays).filter(F.col("ts") >= F.col("now") - F.expr(f"interval {days_back} days"))
    return recent.groupBy("artist").agg(F.count("*").alias("plays")).filter(F.col("plays") >= least)


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """Counts of a column's values and their percentage."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select(value, "n", (F.col("n") * 100.0 / F.col("all")).alias("pct"))


def summary(rows: DataFrame, value: str) -> DataFrame:
    """Mean and exact quantiles of a column."""
    shares = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    found = quantiles(rows, value, list(shares.values())).agg(*(F.max(F.when(F.col("share") == p, F.col("q"))).alias(name) for name, p in shares.items()))
    return rows.agg(F.avg(value).alias("mean")).crossJoin(F.broadcast(found))


def artist_encoding(songs: DataFrame, labelled: DataFrame, k: float = 0.0) -> DataFrame:
    """Each song's artist mean of labels, shrunk to the global mean by `k` pseudo labels; artists
    without a label take the global mean."""
    mean = labelled.groupBy("artist").agg(F.count("label").alias("n"), F.sum("label").alias("s"))
    total = labelled.agg(F.avg("label").alias("g"))
    out = songs.join(mean, "artist", "left").crossJoin(F.broadcast(total))
    return out.withColumn("artist_enc", F.coalesce(F.try_divide(F.col("s") + k * F.col("g"), F.nullif(F.col("n") + k, F.lit(0.0))), F.col("g"))).drop("n", "s", "g")


def with_tier(songs: DataFrame, tiers: DataFrame) -> DataFrame:
    """`songs` with their artist's `tier` (`tiers`: one row an artist); B where it has none."""
    return songs.join(tiers.select("artist", "tier"), "artist", "left").withColumn("tier", F.coalesce("tier", F.lit("B")))
