"""Normal forms, labels and sources on written rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from encore.functions import labels, text
from encore.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,want",
    [("A [live] feat. B", "a"), ("Good Night (좋은 밤)", "good night"), ("defeat the x", "de"), ("  Two   words ", "two words"), ("", ""), ("zero​width", "zerowidth"), (None, None)],
)
def test_normalize_title(spark, raw, want):
    assert one(spark, text.normalize_title(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("Oasis - Topic", "oasis"), ("OasisVEVO", "oasis"), (" Oasis ", "oasis"), ("", "")])
def test_artist_base(spark, raw, want):
    assert one(spark, text.artist_base(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("Oasis - Topic", "oasis"), ("OasisVEVO", "oasisvevo"), (" Oasis ", "oasis"), ("\u200bOa\ufeffsis\u2028 - Topic", "oasis"), ("", "")])
def test_normalize_artist(spark, raw, want):
    """The library's matcher, as the reference has it, drops the topic ending but keeps VEVO."""
    assert one(spark, text.normalize_artist(F.lit(raw))) == want


def test_same_artist(spark):
    cases = [("Oasis - Topic", "oasis", True), ("IU", "IU & Suga", True), ("The Cure", "The Clash", True), ("abba", "xyz", False), ("Beatles", "Beetles", True)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").select(text.same_artist(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in rows] == [c[2] for c in cases]


@pytest.mark.parametrize("ratio,slope,want", [(0.25, -0.4, "critical"), (0.35, -0.25, "severe"), (0.48, -0.15, "mild"), (0.48, -0.05, None), (0.6, -0.9, None)])
def test_severity(spark, ratio, slope, want):
    assert one(spark, labels.severity(F.lit(ratio), F.lit(slope))) == want


@pytest.mark.parametrize("cur,fut,want", [(0, 0, "dead/dormant"), (0, 2, "revived"), (2, 4, "heating"), (4, 1, "cooling"), (4, 4, "stable"), (2, 3, "stable"), (2, 1, "stable")])
def test_state_label(spark, cur, fut, want):
    assert one(spark, labels.state_label(F.lit(cur), F.lit(fut))) == want


@pytest.mark.parametrize("known,want", [(0, "explore"), (3, "expand"), (11, "deep_dive"), (30, None)])
def test_familiarity_tier(spark, known, want):
    assert one(spark, labels.familiarity_tier(F.lit(known))) == want


def test_length_bound_never_hides_a_match(spark):
    words = ["", "a", "ab", "abcd", "abcdefgh", "hgfedcba", "abcdxfgh"]
    rows = spark.createDataFrame([(a, b) for a in words for b in words if a or b], "a string, b string")
    hidden = rows.filter(~text.may_reach(F.col("a"), F.col("b"), 0.6)).filter(text.ratio("a", "b") >= 0.6)
    assert hidden.count() == 0


def test_play_log_csv(spark, tmp_path):
    (tmp_path / "log.csv").write_text("﻿song_id,title,artist,timestamp,skip_type\ns1,T,A,2024-01-01 00:00:00,0\ns2,,,not a time,\n", encoding="utf-8")
    rows = {r["song_id"]: r for r in files.read_play_log(spark, str(tmp_path / "log.csv"), strict=False).collect()}
    assert rows["s1"]["skip_type"] == 0 and rows["s1"]["ts"].year == 2024 and rows["s1"]["familiarity"] is None
    assert rows["s2"]["ts"] is None and rows["s2"]["title"] is None


def test_cache_keeps_matched_rows_and_asks_for_the_rest(spark):
    songs = spark.createDataFrame([("a",), ("b",), ("c",)], "song_id string")
    cache = spark.createDataFrame([("a", True, 1), ("b", False, 0)], "song_id string, matched boolean, n int")
    found = files.crawl(songs, cache, lambda r: {"song_id": r["song_id"], "matched": True, "n": 2} if r["song_id"] != "c" else None, "song_id string, matched boolean, n int")
    assert sorted(map(tuple, found.collect())) == [("a", True, 1), ("b", True, 2)]
