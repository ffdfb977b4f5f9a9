"""Songs to discover, in the library and outside, and songs to hear again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.labels import familiarity_tier
from encore.functions.times import days_floor
from encore.operators import features, matching, ranking, scores

#: Shares of deep_dive, expand and explore by preset.
QUOTAS = {"default": (0.4, 0.4, 0.2), "safe": (0.6, 0.3, 0.1), "adventure": (0.2, 0.3, 0.5)}


def internal_discovery(plays: DataFrame, context: DataFrame, n: int, songs: DataFrame | None = None, signals: DataFrame | None = None) -> DataFrame:
    """Little heard songs: of growing artists first (under 5 plays, two each), then any with at most
    3 plays, affinity from .3 and similarity from 15; one per artist. `context`: song_id, similarity
    (0..100)."""
    songs = scores.song_scores(plays) if songs is None else songs
    signals = scores.growth_signals(plays) if signals is None else signals
    own = Window.partitionBy("artist").orderBy(F.desc("affinity"), "song_id")
    first = songs.join(signals.select("artist", "trigger_song_id"), "artist").filter((F.col("song_id") != F.col("trigger_song_id")) & (F.col("total_plays") < 5))
    first = first.withColumn("rn", F.row_number().over(own)).filter("rn <= 2").select("song_id", "artist", F.lit(1).alias("kind"))
    low = songs.filter((F.col("total_plays") <= 3) & (F.col("affinity") >= 0.3)).select("song_id", "artist", F.lit(2).alias("kind"))
    rows = first.unionByName(low.join(first.select("song_id"), "song_id", "left_anti")).join(context, "song_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    rows = rows.filter((F.col("kind") == 1) | (F.col("similarity") >= 15))
    best = rows.withColumn("rn", F.row_number().over(Window.partitionBy(F.lower(F.col("artist").cast("string"))).orderBy("kind", F.desc("similarity"), "song_id"))).filter("rn = 1")
    return best.select("song_id", "artist", "kind", "similarity").orderBy("kind", F.desc("similarity"), "song_id").limit(n)


def external_discovery(edges: DataFrame, tracks: DataFrame, known: DataFrame, tag_similarity: DataFrame, n: int, preset: str = "default") -> DataFrame:
    """Tracks of artists similar to the library's, not in it yet. score = .5 tag similarity + .3
    match + .2 popularity (within the tier); at most two per artist; quotas by tier, then by score.

    `edges`: seed, name, match; `tracks` (outside the library): ext_id, artist, title, listeners;
    `known`: artist, songs known; `tag_similarity`: ext_id, similarity."""
    best = edges.groupBy("name").agg(F.max("match").alias("match"))
    rows = tracks.join(best, F.col("artist") == F.col("name")).drop("name").join(known, "artist", "left")
    rows = rows.withColumn("tier", familiarity_tier(F.coalesce("songs", F.lit(0)))).filter(F.col("tier").isNotNull())
    rows = rows.join(tag_similarity, "ext_id").filter(F.col("similarity").between(0.25, 0.85))
    most = rows.groupBy("tier").agg(F.max("listeners").alias("__most"))  # three rows
    top = F.col("__most")
    scored = rows.join(F.broadcast(most), "tier").withColumn("score", 0.5 * F.col("similarity") + 0.3 * F.col("match") + 0.2 * F.coalesce(F.try_divide(F.col("listeners"), F.nullif(top, F.lit(0))), F.lit(0.0))).drop("__most")
    capped = ranking.artist_cap(scored, 2, "score", "ext_id")
    a, b, _ = QUOTAS.get(preset, QUOTAS["default"])
    half_even = lambda x: int(round(x))
    quotas = {"deep_dive": half_even(n * a), "expand": half_even(n * b)}
    quotas["explore"] = max(0, n - sum(quotas.values()))
    return ranking.quota_fill(capped, quotas, n, key="ext_id").select("ext_id", "artist", "tier", "score")


def internal_nostalgia(plays: DataFrame, early_days: int = 180, away_days: int = 180, low: int = 3, high: int = 15) -> DataFrame:
    """Songs first heard early, 3 to 15 times, not for half a year, of artists no longer active."""
    songs = plays.filter(F.col("song_id").isNotNull()).groupBy("song_id").agg(F.min_by("artist", F.struct("ts", "tie")).alias("artist"), F.count("*").alias("plays"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    bounds = plays.agg(F.min("ts").alias("start"), F.max("ts").alias("now"))
    rows = songs.crossJoin(F.broadcast(bounds)).withColumn("away", days_floor(F.col("last"), F.col("now")))
    kept = rows.filter((F.col("first") <= F.col("start") + F.expr(f"interval {early_days} days")) & F.col("plays").between(low, high) & (F.col("away") >= away_days))
    return kept.join(features.active_artists(plays).select("artist"), "artist", "left_anti").select("song_id", "artist", "plays", "away")


def external_nostalgia(top_tracks: DataFrame, index: DataFrame, plays: DataFrame, artists: int = 30, per_artist: int = 10) -> DataFrame:
    """Best known tracks of the most played artists that the library lacks."""
    most = plays.filter(F.col("artist").isNotNull()).groupBy("artist").agg(F.count("*").alias("plays")).orderBy(F.desc("plays"), "artist").limit(artists)
    rows = top_tracks.join(F.broadcast(most), "artist").withColumn("rn", F.row_number().over(Window.partitionBy("artist").orderBy(F.desc("listeners"), "ext_id"))).filter(F.col("rn") <= per_artist)
    return matching.not_in_library(rows, index, None).select("ext_id", "artist", "title", "listeners")


def nostalgia_by_tags(tracks: DataFrame, index: DataFrame, per_tag: int = 30) -> DataFrame:
    """The best known tracks of each tag (ext_id, tag, artist, title, listeners) that the library
    lacks, each title of an artist once, with `knows_artist`: whether the library has the artist
    under some name. Known artists come first, then listeners; a title under several tags stays with
    the first tag by name."""
    own = Window.partitionBy("tag").orderBy(F.desc("listeners"), "ext_id")
    best = tracks.withColumn("__rn", F.row_number().over(own)).filter(F.col("__rn") <= per_tag).drop("__rn")
    once = Window.partitionBy(F.lower("artist"), F.lower("title")).orderBy("tag", F.desc("listeners"), "ext_id")
    single = best.withColumn("__rn", F.row_number().over(once)).filter(F.col("__rn") == 1).drop("__rn")
    fresh = matching.not_in_library(single, index, None)
    names = index.select("alias").distinct().withColumn("knows_artist", F.lit(True))
    known = fresh.select("ext_id", F.explode(matching.artist_aliases(F.col("artist"))).alias("alias")).join(names, "alias").select("ext_id", "knows_artist").distinct()
    return fresh.join(known, "ext_id", "left").withColumn("knows_artist", F.coalesce("knows_artist", F.lit(False))).orderBy(F.desc("knows_artist"), F.desc("listeners"), "ext_id")


def top_tags(tags: DataFrame, seeds: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent tags of a playlist (song_id, tags), the seeds' counted three times more."""
    one = tags.select(F.explode("tags").alias("tag"), F.lit(1).alias("w"))
    more = seeds.select(F.explode("tags").alias("tag"), F.lit(3).alias("w"))
    return one.unionByName(more).groupBy("tag").agg(F.sum("w").alias("weight")).orderBy(F.desc("weight"), "tag").limit(n)


def select_nostalgia(candidates: DataFrame, top: DataFrame, n: int = 5) -> DataFrame:
    """Candidates (song_id, tags, knows_artist, source) that share two top tags or more, by the
    share of top tags they have and bonuses."""
    wanted = top.agg(F.collect_set("tag").alias("top"))  # ten tags
    rows = candidates.crossJoin(F.broadcast(wanted)).withColumn("overlap", F.size(F.array_intersect("tags", "top")))
    bonus = F.when(F.col("knows_artist"), 0.15).otherwise(0.0) + F.when(F.col("source") == "internal", 0.1).otherwise(0.0)
    scored = rows.filter("overlap >= 2").withColumn("score", F.round(F.col("overlap") / F.greatest(F.size("top"), F.lit(1)) + bonus, 6))
    return scored.select("song_id", "overlap", "score").orderBy(F.desc("score"), "song_id").limit(n)
