"""Play logs as streams: intensity that is kept up to date, and weekly counts by artist."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "song_id long, R double, last timestamp, plays long"
STATE = "R double, last double, plays long"


def running_intensity(plays: DataFrame, half_life_days: float = 30.0) -> DataFrame:
    """R by song after each batch, at the song's last play. R halves with time, so a sum and a
    moment are all the state: a late play adds what is left of it."""
    life = half_life_days * 86400.0

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r, last, n = state.get if state.exists else (0.0, 0.0, 0)
        for pdf in batches:
            t = pdf["t"].astype("float64")
            now = max(last, float(t.max()))
            r = r * 0.5 ** ((now - last) / life) + float((0.5 ** ((now - t) / life)).sum())
            last, n = now, n + len(pdf)
        state.update((r, last, n))
        yield pd.DataFrame({"song_id": [key[0]], "R": [r], "last": [pd.Timestamp(last, unit="s")], "plays": [n]})

    done = plays.filter((F.col("skip_type") == 0) & F.col("song_id").isNotNull()).select(F.col("song_id").cast("long").alias("song_id"), F.unix_timestamp("ts").alias("t"))
    return done.groupBy("song_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def weekly_plays(plays: DataFrame, late: str = "7 days") -> DataFrame:
    """Plays by artist and week; a week is closed once plays are `late` past its end."""
    weeks = plays.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime="4 days"), "artist").agg(F.count("*").alias("plays"))
    return weeks.select(F.col("window.start").alias("week"), "artist", "plays")


def session_counts(plays: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by user: plays without a longer gap."""
    found = plays.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("plays"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "plays")
