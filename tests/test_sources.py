"""Files in and out, crawls that stop and go on, streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from encore.sources import files
from encore.streaming import intensity


def test_scores_vectors_and_labels(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"a": [1.0, 2.5], "b": []}))
    (tmp_path / "s.json").write_text(json.dumps({"a": {"A": 3.5}, "b": {"A": None}}))
    (tmp_path / "l.csv").write_text("﻿곡,artist,v\nx,y,4.5\nz,w,none\n", encoding="utf-8")
    assert {r["song_id"]: r["v"] for r in files.read_vectors(spark, f"{tmp_path}/v.json").collect()} == {"a": [1.0, 2.5], "b": []}
    assert {r["song_id"]: r["A"] for r in files.read_scores(spark, f"{tmp_path}/s.json").collect()} == {"a": 3.5, "b": None}
    assert [tuple(r) for r in files.read_labels(spark, f"{tmp_path}/l.csv", {"곡": "title", "v": "label"}).collect()] == [("x", "y", 4.5), ("z", "w", None)]


def test_metadata_by_name(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿matched,song_id,genre,release_year\ntrue,a,Pop,1999\nfalse,b,Rock,\n", encoding="utf-8")
    rows = files.read_metadata(spark, f"{tmp_path}/m.csv").collect()
    assert [(r["song_id"], r["genre"], r["release_year"], r["itunes_title"]) for r in rows] == [("a", "Pop", 1999, None)]


def test_label_column_and_existence(spark, tmp_path):
    rows = [(f"t{k}", str(k), str(k % 5), "x", str(k % 4 + 1)) for k in range(9)]
    df = spark.createDataFrame(rows, "title string, plays string, v1 string, note string, v2 string")
    assert files.label_column(df) == "v2" and files.label_column(df.select("title", "note")) is None
    assert files.label_column(df.select("v1", "plays")) == "v1"
    assert not files.exists(spark, f"{tmp_path}/none")
    files.write_table(df, f"{tmp_path}/out", by=["note"])
    assert files.exists(spark, f"{tmp_path}/out") and spark.read.parquet(f"{tmp_path}/out").count() == 9
    files.write_table(df.limit(2), f"{tmp_path}/csv", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == df.columns


def test_crawl_stops_and_goes_on(spark, tmp_path):
    """A service that breaks off once: the steps before it are kept, and no answer is asked for twice."""
    calls, gate = str(tmp_path / "calls"), str(tmp_path / "gate")
    (tmp_path / "gate").write_text("shut")
    songs = spark.createDataFrame([(k, f"t{k}") for k in range(60)], "song_id long, title string")
    fatal = songs.filter(F.pmod(F.xxhash64("song_id"), F.lit(6)) == 3).agg(F.max("song_id")).first()[0]  # in the fourth step of six

    def fetch(row):
        if row["song_id"] == fatal and open(gate).read() == "shut":
            import os

            os._exit(1)  # the worker dies, as a lost executor's does
        with open(calls, "a") as f:
            f.write(f"{row['song_id']}\n")
        if row["song_id"] % 10 == 3:
            return None
        if row["song_id"] % 10 == 4:
            raise OSError("no answer")
        return {"song_id": row["song_id"], "genre": row["title"], "matched": True}

    schema, path = "song_id long, genre string, matched boolean", f"{tmp_path}/crawl"
    with pytest.raises(Exception):  # noqa: B017
        files.crawl_in_steps(songs, path, fetch, schema, every=5, requests=2)
    asked = {int(x) for x in open(calls)}
    before = sum(spark.read.schema(schema).parquet(str(p)).count() for p in (tmp_path / "crawl").iterdir() if (p / "_SUCCESS").exists())
    assert 0 < before < 60
    (tmp_path / "gate").write_text("open")
    (tmp_path / "calls").write_text("")
    found = {r["song_id"]: r for r in files.crawl_in_steps(songs, path, fetch, schema, every=5, requests=2).collect()}
    now = [int(x) for x in open(calls)]
    assert len(now) == len(set(now)) == 60 - before and len(asked) >= before
    assert set(found) == set(range(60)) and all(found[k]["matched"] == (k % 10 not in (3, 4)) for k in found)
    (tmp_path / "calls").write_text("")
    files.crawl_in_steps(songs, path, fetch, schema, every=5, requests=2).count()
    assert open(calls).read() == ""  # what is missing is known to be missing
    again = files.crawl_in_steps(songs, path, fetch, schema, every=5, requests=2, again=True)
    assert again.count() == 60 and sorted(int(x) for x in open(calls)) == sorted(k for k in range(60) if k % 10 in (3, 4))


def test_streams(spark, tmp_path):
    rows = [(1, "a", f"2024-01-0{d} 10:00:00", 0, 5) for d in (1, 2, 3)] + [(1, "a", "2024-01-01 10:10:00", 1, 5), (2, "b", "2024-01-31 00:00:00", 0, 6)]
    df = spark.createDataFrame(rows, "song_id long, artist string, ts string, skip_type int, user_id long").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")

    def run(stream, mode, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    r = {x["song_id"]: (x["R"], x["plays"]) for x in run(intensity.running_intensity(read()), "update", "running")}
    assert r[1][1] == 3 and r[1][0] == pytest.approx(1 + 0.5 ** (1 / 30) + 0.5 ** (2 / 30)) and r[2] == (1.0, 1)
    assert {(x["artist"], str(x["week"])[:10], x["plays"]) for x in run(intensity.weekly_plays(read()), "append", "weeks")} == {("a", "2024-01-01", 4)}
    assert {(x["user_id"], x["plays"]) for x in run(intensity.session_counts(read()), "append", "sessions")} >= {(5, 2)}
