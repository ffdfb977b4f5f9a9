"""Faults that only other rows or larger tables show."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from encore.operators import aliases, boosting, lifecycle, matching, models, order, pointprocess
from encore.plans import catalog, oracles


def test_lyrics_keep_a_number_at_the_end(spark, tmp_path, same_rows):
    words = "la " * 20
    rows = [(1, words + "call 4644348398010899"), (2, words + "12.44.178.86 "), (3, words), (4, "short 7"), (5, None), (6, words + "7Embed")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same_rows(catalog.queries()["lyrics_clean"](spark, str(tmp_path)), oracles.oracle_sql()["lyrics_clean"], con)


@pytest.fixture
def met(monkeypatch):
    """Rows of both sides of every containment join."""
    sizes = []
    for module in (matching, aliases):
        def spied(short, long, *more, _own=module.contained):
            sizes.extend((short.count(), long.count()))
            return _own(short, long, *more)

        monkeypatch.setattr(module, "contained", spied)
    return sizes


def test_tracks_of_one_name_meet_the_library_once(spark, met):
    external = spark.createDataFrame([(k, "Sea (olive)", "A") for k in range(40)] + [(99, "Other", "A")], "ext_id long, title string, artist string")
    songs = spark.createDataFrame([(k, "Green olive tree", "A", 1) for k in range(30)], "song_id long, title string, artist string, plays long")
    found = matching.matches(external, matching.library_index(songs))
    assert sorted(r["ext_id"] for r in found.collect()) == list(range(40))
    assert met and max(met) <= 2


def test_seeds_of_one_name_meet_the_songs_once(spark, met):
    songs = spark.createDataFrame([(k, "Green tree", "The A") for k in range(5, 35)] + [(1, "Green tree", None)], "song_id long, title string, artist string")
    seeds = spark.createDataFrame([(k, "GREEN", "a") for k in range(40)] + [(50, "red", "a"), (51, None, "a"), (52, "green", None)], "seed_id long, title string, artist string")
    got = {r["seed_id"]: r["song_id"] for r in aliases.resolve_seeds(songs, seeds).collect()}
    assert got == {**dict.fromkeys(range(40), 5), 50: None, 51: None, 52: None}
    assert met and max(met) <= 3


def test_no_side_of_a_text_join_is_broadcast_by_its_size_in_files(spark):
    songs = spark.createDataFrame([(1, "Green tree", "A")], "song_id long, title string, artist string")
    plan = aliases.resolve_seeds(songs, songs.withColumnRenamed("song_id", "seed_id"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def _brute(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        mean = {k: d[i, c == k].sum() / ((c == k).sum() - (k == c[i])) for k in np.unique(c) if (c == k).sum() > (k == c[i])}
        a, b = mean.get(c[i]), min(v for k, v in mean.items() if k != c[i])
        out.append(0.0 if a is None else (b - a) / max(a, b))
    return out


def test_silhouette_by_parts_sends_a_row_once_for_each(spark, monkeypatch):
    """Parts are few, however small a block: what is shuffled grows with the rows."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(140, 3)) + 1000, np.repeat(rng.normal(size=(20, 3)), 3, 0)])
    c = np.array([*rng.integers(0, 3, 199), 7])
    frame = spark.createDataFrame([(k, v.tolist(), int(g)) for k, (v, g) in enumerate(zip(x, c, strict=True))], "id long, v array<double>, g long")
    for block, cells, parts in ((1, 4, 4), (1000, 4, 1), (1, 12, 12)):
        got = models.silhouette(frame, "id", "v", "g", block=block, cells=cells)
        assert parts == 1 or f", {parts * (parts + 1) // 2}), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
        assert [r["silhouette"] for r in got.orderBy("id").collect()] == pytest.approx(_brute(x, c), abs=1e-9)


def test_kmeans_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(40).select(F.col("id").cast("double").alias("x")).mapInArrow(run, "x double")
    models.kmeans(models.scaled(rows, ["x"]), 2, 3).count()
    assert seen.value <= 3 * 40  # the means and the rows


def test_fits_side_by_side_are_those_of_each_song(spark):
    rng = np.random.default_rng(3)
    songs = [np.sort(1 + rng.exponential(20 + 30 * i, int(rng.integers(16, 50)))) for i in range(20)]
    ends = np.array([t[-1] + 5 for t in songs])
    for shape, rounds in ((None, 6), (0.7, 4)):
        got = np.array(pointprocess.fit_many(songs, ends, shape, rounds)).T
        assert got == pytest.approx(np.array([pointprocess.fit_weibull(t, e, shape, rounds) for t, e in zip(songs, ends, strict=True)]), rel=1e-9)
    rows = [(i, float(x), float(e)) for i, (t, e) in enumerate(zip(songs, ends, strict=True)) for x in t]
    fits = pointprocess.fit_songs(spark.createDataFrame(rows, "song_id long, t double, horizon double"))
    assert "FlatMapGroupsInPandas" not in fits._jdf.queryExecution().executedPlan().toString()
    assert {r["song_id"]: (r["n"], r["k"]) for r in fits.collect()} == {i: (len(t), pytest.approx(pointprocess.fit_weibull(t, e)[0])) for i, (t, e) in enumerate(zip(songs, ends, strict=True))}


def test_fits_order_only_the_rows_they_see(spark):
    rows = spark.range(4000).select(F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("fit"), F.col("id").alias("key"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 7).cast("double").alias("y"), F.array(F.col("id").cast("double")).alias("x"), F.lit(None).cast("array<double>").alias("own"))
    within = rows.join(boosting._reach(rows, 50), "fit").filter(F.shiftright(F.xxhash64("key"), boosting.SHIFT) <= F.col("__reach"))
    by = {r["fit"]: r["count"] for r in within.groupBy("fit").count().collect()}
    assert set(by) == {"f0", "f1"} and all(50 <= n <= 60 for n in by.values())
    few = boosting.Boosting(trees=2, depth=1)
    first = rows.withColumn("p", F.row_number().over(Window.partitionBy("fit").orderBy(F.xxhash64("key"), "key"))).filter("p <= 50").drop("p")
    a, b = boosting.fit_folds(rows, 0, few, most=50), boosting.fit_folds(first, 0, few, most=1000)
    pred = lambda m: [(r["key"], round(r["predicted"], 9)) for r in boosting.score(rows.filter("key < 200").select("fit", F.lit(0).alias("fold"), "key", "x"), m, few).orderBy("key").collect()]
    assert a.count() == 2 and pred(a) == pred(b)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_correlation_by_group_does_not_multiply_rows(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 3, 6), (2, 1, 4), (2, 2, 4), (3, 1, None), (3, 2, 9)], "g int, x int, y int")
    found = lifecycle.spearman(rows, "x", "y", ["g"])
    assert "Expand" not in _plan(found)
    assert {r["g"]: (r["n"], r["rho"]) for r in found.collect()} == {1: (3, pytest.approx(0.5)), 2: (2, None), 3: (1, None)}


def test_parts_to_sort_grow_with_the_rows(spark, monkeypatch):
    plays = spark.range(3000).select((F.col("id") % 7).alias("song_id"), F.timestamp_seconds("id").alias("ts"), F.struct("id").alias("tie"))
    want = sorted(map(tuple, lifecycle.exposure_intervals(plays).collect()))
    monkeypatch.setattr(order, "ROWS", 100)
    rows = lifecycle.exposure_intervals(plays)
    assert "hashpartitioning(song_id" in _plan(rows) and "REPARTITION_BY_NUM" in _plan(rows) and ", 30)" in _plan(rows)
    assert sorted(map(tuple, rows.collect())) == want and len(want) == 2993


@pytest.mark.parametrize("name", ["mixer_playlist", "recommend", "recommend_summary"])
def test_the_log_is_made_once(spark, sf_dir, monkeypatch, name):
    """Nothing but the staged log reads the tables."""
    made = []
    own = catalog.plays_d
    monkeypatch.setattr(catalog, "plays_d", lambda *a: made.append(a) or own(*a))
    found = catalog.queries()[name](spark, sf_dir)
    assert len(made) == 1 and not any("/lineitem.parquet" in f for f in found.inputFiles())


def test_sums_of_distances_for_both_sides_at_once():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(301, 5)) * 100, rng.normal(size=(530, 5))
    y[7], y[300], x[200] = x[3], x[3] + 1e-7, 1e4
    is_x, is_y = np.eye(3)[rng.integers(0, 3, 301)], np.eye(2)[rng.integers(0, 2, 530)]
    gap = np.sqrt(((x[:, None] - y) ** 2).sum(-1))
    of_x, of_y = models.distance_sums(x, y, is_x, is_y, False)
    assert of_x == pytest.approx(gap @ is_y, rel=1e-11) and of_y == pytest.approx(gap.T @ is_x, rel=1e-11)
    near, none = models.distance_sums(x[[3]], y[[7, 300]], np.ones((1, 1)), np.eye(2), True)
    assert near == pytest.approx(np.array([[0.0, np.sqrt(5) * 1e-7]]), rel=1e-4) and not none.any()
