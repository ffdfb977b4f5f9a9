"""Names of songs and seeds against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from encore.operators import aliases, discovery, ranking
from encore.plans import catalog, recommendation
from encore.sources.adapters import plays_e

SONGS = [
    (1, "Blue spring (작전명 청-춘!)", "JANNABI - Topic"), (2, "Summer", "JANNABI - Topic"), (3, "밤편지", "IU"), (4, "Through the Night", "IU - Topic"), (5, "Antifreeze (부동액) (live)", "The Black Skirts - Topic"),
    (6, "Summer", "The Volunteers"), (7, None, None), (8, "Tell me (Remix)", "jannabi"), (9, "TOMBOY", "HYUKOH - Topic"), (10, "톰보이", "Other"),
]


@pytest.fixture(scope="module")
def index(spark):
    songs = spark.createDataFrame(SONGS, "song_id long, title string, artist string")
    meta = spark.createDataFrame([(4, "old", 1), (4, "밤편지", 2), (6, "Summer", 1), (2, "여름", 1)], "song_id long, found_title string, place long")
    return aliases.build_aliases(songs, meta).cache()


def test_build(index):
    got = {r["song_id"]: (r["title_kr"], r["aliases"]) for r in index.collect()}
    assert got[1] == ("작전명 청-춘!", ["Blue spring", "작전명 청-춘!"])
    assert got[2] == ("뜨거운 여름밤은 가고 남은 건 볼품없지만", ["뜨거운 여름밤은 가고 남은 건 볼품없지만", "여름"])
    assert got[3] == ("밤편지", []) and got[4] == ("밤편지", ["밤편지"])
    assert got[5] == ("부동액", ["Antifreeze", "부동액"]) and got[6] == (None, []) and got[7] == (None, [])
    assert got[8] == ("꿈나라 별나라", ["꿈나라 별나라"]) and got[9] == ("톰보이", ["톰보이"])


def test_find(index):
    find = lambda *a: [(r["song_id"], r["score"]) for r in aliases.find_song(index, *a).collect()]
    assert find("summer") == [(6, 1.0)]  # the last song of a name has it
    assert find("Summer", "잔나비") == [(2, 0.8)]  # another artist's: the parts decide
    assert find("톰보이", "혁오") == [(9, 0.9)] and find("톰보이") == [(10, 1.0)]
    assert find("밤편지", "아이유") == [(4, 1.0)]
    assert find("밤") == [(2, 0.9), (3, 0.9), (4, 0.9)]
    assert find("antifreeze ", "the black") == [(5, 1.0)] and find("nothing like it") == []
    assert aliases.find_song(index, "톰보이", "혁오").first()["display"] == "톰보이 (TOMBOY) — HYUKOH"


def test_names(index):
    got = {r["name"]: r["song_id"] for r in aliases.names_of(index).collect()}
    assert got["summer"] == 6 and got["톰보이"] == 10 and got["밤편지"] == 4 and got["blue spring"] == 1 and "" not in got


def test_seeds(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abC") for _ in range(rng.randint(0, 5)))
    songs = [(k, rng.choice([word(), None]), rng.choice(["xy", "Xyz", "", None])) for k in range(60)]
    seeds = [(k, rng.choice([word(), word() + word(), None]), rng.choice(["x", "XY", "q", "", None])) for k in range(80)]
    due = {}
    for s, t, a in seeds:
        fits = [k for k, lt, la in songs if t and lt and a is not None and la is not None and (t.lower() in lt.lower() or lt.lower() in t.lower()) and a.lower() in la.lower()]
        due[s] = min(fits, default=None)
    lib = spark.createDataFrame(songs, "song_id long, title string, artist string")
    asked = spark.createDataFrame(seeds, "seed_id long, title string, artist string")
    assert {r["seed_id"]: r["song_id"] for r in aliases.resolve_seeds(lib, asked).collect()} == due
    assert any(v is not None for v in due.values()) and None in due.values()


def test_neighbours_apart():
    """The rule as the reference states it, step by step."""

    def plain(a):
        a = list(a)
        for _ in range(3):
            swapped = False
            for i in range(1, len(a)):
                if a[i] == a[i - 1]:
                    for j in range(i + 1, len(a)):
                        if a[j] != a[i] and (j == len(a) - 1 or a[j] != a[j + 1]) and a[j] != a[j - 1]:
                            a[i], a[j] = a[j], a[i]
                            swapped = True
                            break
            if not swapped:
                break
        return a

    rng = random.Random(4)
    for _ in range(500):
        a = [rng.choice("aabcd") for _ in range(rng.randint(0, 14))]
        found = ranking.apart(a)
        assert sorted(found) == list(range(len(a))) and [a[k] for k in found] == plain(a)


def test_mixer_fills_what_discoveries_lack(spark):
    songs = spark.createDataFrame([(k, f"a{k % 30}", 0.5, 0.5, 100.0, None) for k in range(60)], "song_id long, artist string, affinity double, momentum double, context double, A double")
    found = spark.createDataFrame([(100, "a1", 1.0)], "song_id long, artist string, score double")
    for preset in (*ranking.PRESETS, "lgbm"):
        rows = ranking.mixer(songs, found, 20, preset).collect()
        assert sorted(r["pos"] for r in rows) == list(range(20)) and [r["song_id"] for r in rows if r["is_new"]] == [100] and len({r["song_id"] for r in rows}) == 20


def test_recommendation_is_its_steps(spark, sf_dir):
    log = plays_e(spark, sf_dir).drop("user_id")
    near = catalog.catalogue(log).select("song_id", (F.col("song_id") % 50).cast("double").alias("similarity"))
    got = recommendation.recommend(log, near, size=15, preset="explore")
    rows = got["playlist"].collect()
    assert sorted(r["pos"] for r in rows) == list(range(len(rows))) and len({r["song_id"] for r in rows}) == len(rows)
    alone = discovery.internal_discovery(got["plays"], near, 6, got["scores"])
    assert {r["song_id"] for r in got["discoveries"].collect()} == {r["song_id"] for r in alone.collect()}
    again = ranking.mixer(got["weights"].drop("weight").filter("momentum > 0.05"), got["discoveries"], 15, "explore")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    sections = {(r["section"], r["name"]): r["n"] for r in recommendation.summary(got).collect()}
    assert sections["rows", "plays"] == log.count() and sum(n for (s, _), n in sections.items() if s == "tier") == sections["rows", "scores"]
    assert recommendation.recommend(log, near, preset="lgbm", size=15)["playlist"].count() == len(rows)
