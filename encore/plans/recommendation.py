"""From a play log to a playlist in six steps, each computed once and shared by those after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.operators import discovery, features, matching, models, ranking, scores
from encore.staging import stage


def recommend(plays: DataFrame, context: DataFrame | None = None, external: DataFrame | None = None, predicted: DataFrame | None = None, size: int = 20, preset: str = "default") -> dict[str, DataFrame]:
    """The steps' tables by name: plays, tiers, scores, growth, decline, weights, discoveries, playlist.

    1 artists of one name are brought together; 2 artists get tiers; 3 songs get affinity and
    momentum; 4 growing and declining artists are found; 5 every song is weighed by preset, with
    `context` (song_id, similarity 0..100; none counts 100) and, for `lgbm`, `predicted` (song_id, A;
    without it the default preset is taken); 6 little heard songs of growing artists and `external`
    finds (song_id, artist, score, none of the library) are mixed with the best.

    Discoveries are split as the reference does: max(1, round(share)) from the library, the rest from
    outside, with as many from the library where there is no outside."""
    if preset == "lgbm" and predicted is None:
        preset = "default"
    named = matching.merge_artists(plays.withColumn("artist", F.col("artist").cast("string")))
    log = stage(named.withColumn("artist", F.coalesce("artist_key", "artist")).drop("artist_key"), "plays")
    tiers = stage(models.artist_tiers(log), "tiers")
    songs = stage(features.with_tier(scores.song_scores(log), tiers), "scores")
    growth = stage(scores.growth_signals(log), "growth")
    decline = stage(scores.decline_signals(log), "decline")
    near = songs.select("song_id", F.lit(100.0).alias("similarity")) if context is None else context
    ready = songs.join(near.select("song_id", F.col("similarity").alias("context")), "song_id", "left")
    if predicted is not None:
        ready = ready.join(predicted.select("song_id", "A"), "song_id", "left")
    weights = stage(ranking.mixed_weights(ready.withColumn("context", F.coalesce("context", F.lit(0.0))), preset), "weights")
    share = (ranking.LGBM if preset == "lgbm" else ranking.PRESETS[preset])[3]
    n_new = max(1, int(share * size))
    own = discovery.internal_discovery(log, near, n_new, songs, growth).select("song_id", "artist", (F.lit(2.0) - F.col("kind") + F.col("similarity") / 100.0).alias("score"))
    found = stage(own if external is None else own.unionByName(external.select("song_id", "artist", "score")), "discoveries")
    playlist = ranking.mixer(weights.drop("weight").filter("momentum > 0.05"), found, size, preset)
    return {"plays": log, "tiers": tiers, "scores": songs, "growth": growth, "decline": decline, "weights": weights, "discoveries": found, "playlist": playlist}


def summary(steps: dict[str, DataFrame]) -> DataFrame:
    """(section, name, n, value): what the steps found, for a report: rows of each table, songs and
    mean affinity by tier and by zone, and declining artists by severity."""
    count = lambda section, name, df: df.agg(F.lit(section).alias("section"), F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(None).cast("double").alias("value"))
    by = lambda section, df, key, value: df.groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n"), F.avg(value).alias("value")).select(F.lit(section).alias("section"), "name", "n", "value")
    out = by("tier", steps["scores"], "tier", "affinity").unionByName(by("zone", steps["scores"], "zone", "affinity")).unionByName(by("decline", steps["decline"], "severity", "ratio"))
    for name in ("plays", "scores", "growth", "decline", "discoveries", "playlist"):
        out = out.unionByName(count("rows", name, steps[name]))
    return out
