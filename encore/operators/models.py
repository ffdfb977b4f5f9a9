"""Fitted models on `pyspark.ml`: tiers, curves, components, affinity, what the next weeks bring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.times import uniform
from encore.operators import features, lifecycle
from encore.operators.boosting import PANEL, REVIVAL, Boosting, apply_trees, edges, fit_folds, matrix, score, unpacked
from encore.staging import stage

#: Songs that a task foretells by all models of a comparison, about.
SONGS = 4_000


def scaled(rows: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """`rows` with a vector of the columns by mean and population deviation."""
    stats = rows.agg(*(x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.nullif(f"s_{c}", F.lit(0.0))), F.lit(0.0)) for c in columns]
    return rows.crossJoin(F.broadcast(stats)).withColumn(out, array_to_vector(F.array(*z))).drop(*(f"{p}_{c}" for c in columns for p in "ms"))


def kmeans(rows: DataFrame, k: int, seeds: int = 10, seed: int = 42) -> DataFrame:
    """`rows` with `cluster`, by the cheapest of several starts. Rows are computed once: every step of
    every start goes over them."""
    rows = stage(rows, "kmeans")
    fits = [KMeans(k=k, seed=seed + i, maxIter=50).fit(rows) for i in range(seeds)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).withColumnRenamed("prediction", "cluster")


def artist_tiers(plays: DataFrame, seeds: int = 10) -> DataFrame:
    """(artist, total_plays, tier): three clusters, S, A, B by their mean plays."""
    columns = ["unique_songs", "total_plays", "recent_plays_30d", "listening_span_days", "play_density", "days_since_last"]
    stats = stage(features.artist_stats(plays), "artists")  # k-means goes over its rows many times
    rows = kmeans(scaled(stats, columns), 3, seeds).select("artist", "total_plays", "cluster")
    order = rows.groupBy("cluster").agg(F.avg("total_plays").alias("m")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("m"), "cluster")))  # three rows
    tier = F.element_at(F.array(F.lit("S"), F.lit("A"), F.lit("B")), F.col("place"))
    return rows.join(F.broadcast(order.select("cluster", tier.alias("tier"))), "cluster").select("artist", "total_plays", "tier")


def _curves(plays: DataFrame, k: int, seeds: int, least: int) -> tuple[DataFrame, DataFrame | None]:
    bins = lifecycle.life_bins(plays)
    wide = stage(bins.groupBy("song_id").agg(*(F.max(F.when(F.col("bin") == i, F.col("mean_interval"))).alias(f"y{i}") for i in range(5))), "bins")
    if wide.limit(least).count() < least:
        return wide, None
    return wide, kmeans(scaled(wide, [f"y{i}" for i in range(5)]), k, seeds)


def curve_clusters(plays: DataFrame, k: int = 2, seeds: int = 10, least: int = 10) -> DataFrame:
    """(song_id, cluster) of the songs' five-part life curves, each part by its mean and deviation
    over the songs; no row for fewer than `least` songs."""
    wide, found = _curves(plays, k, seeds, least)
    return wide.select("song_id", F.lit(0).alias("cluster")).limit(0) if found is None else found.select("song_id", "cluster")


def pca(rows: DataFrame, k: int, key: str, vector: str = "v") -> tuple[DataFrame, list[float]]:
    """(key, pc) of centred vectors, and the share of variance of each component."""
    long = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    mean = long.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    ready = rows.crossJoin(F.broadcast(mean)).withColumn("__x", array_to_vector(F.zip_with(vector, "mean", lambda x, m: x - m)))
    model = PCA(k=k, inputCol="__x", outputCol="__pc").fit(ready)
    return model.transform(ready).select(key, vector_to_array("__pc").alias("pc")), list(model.explainedVariance)


def with_components(songs: DataFrame, vectors: DataFrame, k: int = 8, name: str = "audio") -> DataFrame:
    """`songs` with their vector's first k principal components, `{name}_0` on. Vectors (song_id, v)
    are taken by column mean and deviation over all songs, a song without one has the means. Each
    component's largest weight is positive, so signs don't depend on the solver."""
    rows = stage(songs.join(vectors.select("song_id", F.transform("v", lambda x: x.cast("double")).alias("__v")), "song_id", "left"), "vectors")
    stats = rows.filter(F.col("__v").isNotNull()).agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("__v")).alias("s")).select(vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"), F.col("s.count").alias("k")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    stats = stats.select("m", F.transform("v", lambda x: F.sqrt(x * (F.col("k") - 1) / F.col("n")) + 1e-9).alias("d"))
    z = F.zip_with(F.zip_with(F.coalesce("__v", "m"), "m", lambda x, m: x - m), "d", lambda x, d: x / d)
    ready = stage(rows.crossJoin(F.broadcast(stats)).withColumn("__z", array_to_vector(z)).drop("__v", "m", "d"), "scaled")
    weights = PCA(k=k, inputCol="__z", outputCol="__pc").fit(ready).pc.toArray()
    weights = weights * np.sign(weights[np.abs(weights).argmax(0), np.arange(k)])
    own = vector_to_array("__z")
    dot = lambda w: F.aggregate(F.zip_with(own, F.array(*(F.lit(float(x)) for x in w)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return ready.select("*", *(dot(weights[:, i]).alias(f"{name}_{i}") for i in range(k))).drop("__z")


def distance_sums(x: np.ndarray, y: np.ndarray, is_x: np.ndarray, is_y: np.ndarray, own: bool, rows: int = 128, columns: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Sums of Euclidean distances of each row of x to y by y's cluster, and of each row of y to x by
    x's (zeros where both are the same rows, `own`). `is_x`, `is_y`: rows x clusters, 0 or 1.

    Squares come from one product of a few rows and columns at a time, which stays in the processor's
    cache; where that would lose digits (near pairs), by differences."""
    of_x, of_y = np.zeros((len(x), is_y.shape[1])), np.zeros((len(y), is_x.shape[1]))
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    left, right = np.c_[x, xx, np.ones(len(x))], np.ascontiguousarray(np.c_[-2.0 * y, np.ones(len(y)), yy].T)
    room, by_x = np.empty(rows * columns), np.ascontiguousarray(is_x.T)
    for lo in range(0, len(x), rows):
        some = slice(lo, min(lo + rows, len(x)))
        for to in range(0, len(y), columns):
            cols = slice(to, min(to + columns, len(y)))
            n, m = some.stop - lo, cols.stop - to
            gap = np.matmul(left[some], right[:, cols], out=room[: n * m].reshape(n, m))
            least = 1e-6 * (xx[some].max() + yy[cols].max())
            if not gap.min() > least:
                i, j = np.nonzero(~(gap > least))
                gap[i, j] = ((x[lo + i] - y[to + j]) ** 2).sum(1)
            np.sqrt(gap, out=gap)
            of_x[some] += gap @ is_y[cols]
            if not own:
                of_y[cols] += (by_x[:, some] @ gap).T
    return of_x, of_y


def silhouette(rows: DataFrame, key: str, vector: str, cluster: str, block: int = 2048, cells: int = 12, most: int = 4_000_000) -> DataFrame:
    """(key, cluster, silhouette) by exact Euclidean distances: how much nearer a row lies to its own
    cluster than to the nearest other; 0 in a cluster of one, null where there is one cluster.

    Rows are dealt by a hash of the key to `cells` parts (fewer if a part would hold under `block`
    rows, more if one would hold over `most` numbers), and every pair of parts is one group that puts
    out sums of distances by row and cluster for both. A row is sent once for each part, so what is
    shuffled grows with the rows; the work grows with their square, as the measure does."""
    rows = stage(rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.col(cluster).isNotNull()).select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.col(cluster).cast("long").alias("c")), "points")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    parts = max(1, min(-(-size["n"] // block), cells), -(-size["numbers"] // most))
    number = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    placed = rows.withColumn("number", number)
    left = placed.select("*", F.col("number").alias("a"), F.explode(F.sequence(F.col("number"), F.lit(parts - 1))).alias("b"))
    right = placed.filter("number > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("number") - 1)).alias("a"), F.col("number").alias("b"))
    left, right = (side.drop("number").repartition(parts * (parts + 1) // 2, "a", "b") for side in (left, right))  # cells are small but dear

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        some = one if len(one) else two
        schema = pa.schema([("key", some.schema.field("key").type if len(some) else pa.int64()), ("c", pa.int64()), ("other", pa.int64()), ("s", pa.float64())])
        own = bool(len(one)) and one.column("a")[0].as_py() == one.column("b")[0].as_py()
        if own:
            two = one
        if not len(one) or not len(two):
            return schema.empty_table()
        x, y = (t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t in (one, two))
        middle = (x.mean(0) + y.mean(0)) / 2
        x, y = x - middle, y - middle
        (names_x, at_x), (names_y, at_y) = (np.unique(t.column("c").to_numpy(), return_inverse=True) for t in (one, two))
        is_x, is_y = np.eye(len(names_x))[at_x], np.eye(len(names_y))[at_y]
        of_x, of_y = distance_sums(x, y, is_x, is_y, own)

        def sums(t: pa.Table, names: np.ndarray, total: np.ndarray) -> pa.Table:
            each = pa.array(np.repeat(np.arange(len(t)), len(names)))
            return pa.Table.from_arrays([*(t.column(c).combine_chunks().take(each) for c in ("key", "c")), pa.array(np.tile(names, len(t))), pa.array(total.ravel())], schema=schema)

        return sums(one, names_y, of_x) if own else pa.concat_tables([sums(one, names_y, of_x), sums(two, names_x, of_y)])

    kind = rows.schema["key"].dataType.simpleString()
    sums = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, f"key {kind}, c long, other long, s double")
    sizes = rows.groupBy(F.col("c").alias("other")).agg(F.count("*").alias("k"))
    each = sums.groupBy("key", "c", "other").agg(F.sum("s").alias("s")).join(sizes, "other")
    own = F.max(F.when(F.col("c") == F.col("other"), F.try_divide(F.col("s"), (F.col("k") - 1).cast("double"))))
    found = each.groupBy("key", "c").agg(own.alias("a"), F.max(F.when(F.col("c") == F.col("other"), F.col("k"))).alias("n"), F.min(F.when(F.col("c") != F.col("other"), F.col("s") / F.col("k"))).alias("b"))
    value = F.when(F.col("b").isNull(), None).when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return found.select(F.col("key").alias(key), F.col("c").alias(cluster), value.alias("silhouette"))


def curve_silhouette(plays: DataFrame, k: int = 2, seeds: int = 10, least: int = 10) -> DataFrame:
    """(songs, silhouette): the mean over the songs' life curves of `curve_clusters`; none for fewer
    than `least` songs. Under .25 there are no two kinds of songs."""
    wide, found = _curves(plays, k, seeds, least)
    if found is None:
        return wide.agg(F.count("*").alias("songs"), F.lit(None).cast("double").alias("silhouette")).filter("songs < 0")
    return silhouette(found.select("song_id", vector_to_array("features").alias("v"), "cluster"), "song_id", "v", "cluster").agg(F.count("*").alias("songs"), F.avg("silhouette").alias("silhouette"))


def first_component_share(plays: DataFrame, points: int = 21) -> DataFrame:
    """How much of the variance of songs' cumulative curves their first component takes."""
    curve = lifecycle.cumulative_curve(plays, points).groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "y"))), lambda x: x["y"]).alias("v"))
    _, share = pca(stage(curve, "curves"), 3, "song_id")
    return plays.sparkSession.createDataFrame([(k + 1, float(x)) for k, x in enumerate(share)], "component int, share double")


def fold_of(key: str, folds: int = 5, seed: str = "fold") -> Column:
    """A fold by a hash of the key, so that all rows of a key are in one."""
    return F.floor(uniform(seed, F.col(key)) * folds).cast("int")


def numbers(columns: list[str]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in columns))


def amplitude(songs: DataFrame, labels: DataFrame, columns: list[str], p: Boosting = Boosting()) -> DataFrame:
    """(song_id, A): affinity from behaviour and the artist's mean label, in two passes. The second
    encodes artists from labels and, where there is none, from the first pass's predictions."""
    rows = stage(songs.join(labels, "song_id", "left"), "amplitude")

    def fitted(source: DataFrame) -> DataFrame:
        coded = features.artist_encoding(rows, source).select("song_id", "artist", "label", numbers([*columns, "artist_enc"]).alias("x"))
        coded = coded.withColumns({"fit": F.lit("A"), "fold": F.lit(0), "key": F.col("song_id"), "y": F.col("label"), "own": F.lit(None).cast("array<double>")})
        coded = stage(coded, "coded")
        return score(coded.select("fit", "fold", "song_id", "artist", "label", "x"), fit_folds(coded, 0, p), p).withColumnRenamed("predicted", "A")

    first = stage(fitted(rows.filter("label is not null")), "pass")
    return fitted(first.select("artist", F.coalesce("label", "A").alias("label"))).select("song_id", "A")


def in_folds(labelled: DataFrame, reps: int, folds: int) -> DataFrame:
    """`labelled` once for each repetition, with `rep` and the `fold` of its song in it."""
    rows = labelled.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return rows.withColumn("fold", F.floor(uniform("rep", F.concat_ws(":", "rep", "song_id")) * folds).cast("int"))


def _others(sums: DataFrame, keys: list[str], folds: int) -> DataFrame:
    """From sums (keys, fold, n, s) those of all other folds, for every fold: the total less its part."""
    each = sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "s").alias("v")))).alias("part"))
    rows = each.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("p", F.try_element_at("part", F.col("fold")))
    return rows.select(*keys, "fold", (F.col("n") - F.coalesce("p.n", F.lit(0))).alias("n"), (F.col("s") - F.coalesce("p.s", F.lit(0.0))).alias("s"))


def fold_sums(labelled: DataFrame, reps: int, folds: int) -> tuple[DataFrame, DataFrame]:
    """Labels by artist outside each fold of each repetition (rep, artist, fold, n, s), and their
    mean over all artists (rep, fold, g), from one pass of sums."""
    parts = stage(in_folds(labelled, reps, folds).groupBy("rep", "artist", "fold").agg(F.count("label").alias("n"), F.sum("label").alias("s")), "folds")
    whole = _others(parts.groupBy("rep", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), ["rep"], folds)
    return _others(parts.filter("artist is not null"), ["rep", "artist"], folds), whole.select("rep", "fold", F.try_divide("s", "n").alias("g"))


def fold_encodings(songs: DataFrame, labelled: DataFrame, reps: int = 10, folds: int = 5, k: float = 3.0) -> DataFrame:
    """(rep, fold, song_id, artist, mean_enc, shrink_enc, n, s, g): for every fold its songs' artists
    by the labels of the other folds only: their mean, and the mean drawn to that of all by `k`
    labels. Artists without a label outside the fold take the mean of all."""
    by_artist, whole = fold_sums(labelled, reps, folds)
    grid = songs.select("song_id", "artist").crossJoin(F.broadcast(whole))  # a row for each fold of each repetition
    rows = grid.join(by_artist, ["rep", "fold", "artist"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "s": F.coalesce("s", F.lit(0.0))})
    return rows.select("rep", "fold", "song_id", "artist", F.coalesce(F.try_divide("s", "n"), "g").alias("mean_enc"), ((F.col("s") + k * F.col("g")) / (F.col("n") + k)).alias("shrink_enc"), "n", "s", "g")


def _guessed(songs: DataFrame, models: DataFrame, sets: dict[str, list[str]], folds: int, p: Boosting) -> DataFrame:
    """(feature_set, rep, fold, artist, np, sp): how many songs of an artist the models foretell, and
    the sum of what they do.

    `songs` (artist, features, `means`: the artist's encoding in fold f of repetition r as element
    r * folds + f) stay one row each and meet every model where they are: the models, a fixed number
    (sets x repetitions x folds) of some 100 KB, travel instead. Tasks add up by artist first."""
    own = sorted((name, int(rep), r["fold"], r["model"]) for r in models.collect() for name, rep in [r["fit"].rsplit(":", 1)])
    every = list(dict.fromkeys(c for columns in sets.values() for c in columns))
    at = {name: [every.index(c) for c in columns] for name, columns in sets.items()}
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.float64()]
    names = ["feature_set", "rep", "fold", "artist", "np", "sp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = None
        for batch in batches:
            if not len(batch):
                continue
            ready = ready or [(name, rep, fold, unpacked(data)) for name, rep, fold, data in own]
            coded = batch.column("artist").dictionary_encode()
            artists, which = coded.dictionary.to_pylist(), coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            x, means = matrix(batch.column("x")), matrix(batch.column("means"))
            n = np.bincount(which, minlength=len(artists) + 1)
            some = np.flatnonzero(n)
            held = [(artists[k] if k < len(artists) else None) for k in some.tolist()]
            for name, rep, fold, model in ready:
                sums = np.bincount(which, apply_trees(model, np.c_[x[:, at[name]], means[:, rep * folds + fold]], p.logistic), len(artists) + 1)
                values = [[name] * len(some), [rep] * len(some), [fold] * len(some), held, n[some], sums[some]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)

    rows = songs.select(F.col("artist").cast("string").alias("artist"), numbers(every).alias("x"), "means")
    found = rows.mapInArrow(run, "feature_set string, rep int, fold int, artist string, np long, sp double")
    return found.groupBy("feature_set", "rep", "fold", "artist").agg(F.sum("np").alias("np"), F.sum("sp").alias("sp"))


def encoder_comparison(songs: DataFrame, labels: DataFrame, sets: dict[str, list[str]], reps: int = 10, folds: int = 5, p: Boosting = Boosting()) -> DataFrame:
    """(feature_set, encoder, r, spread): how well labels are foretold out of fold, for every set of
    features and three encoders of artists, as mean and deviation of Pearson's r over repetitions.

    Encoders: `mean` and `shrink` as in `fold_encodings`; `semi` adds the songs without a label, by
    what a first pass with `mean` foretells of them. Each is made anew for every fold from the other
    folds' labels. Songs are those of `songs` (song_id, artist, features); a fit sees all that have a
    label."""
    rows = stage(songs.join(labels, "song_id", "left"), "songs")
    known = rows.filter("label is not null")
    coded = stage(fold_encodings(known, known.select("song_id", "artist", "label"), reps, folds), "encodings")
    spread = in_folds(known, reps, folds)
    wide = lambda enc, keys: enc.groupBy(*keys, "song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "e"))), lambda x: x["e"]).alias("own"))

    def asked(name: str, columns: list[str], enc: DataFrame) -> DataFrame:
        """Rows to fit: `enc` holds (rep, fold, song_id, e)."""
        own = wide(enc, ["rep"])
        return spread.join(own, ["rep", "song_id"]).select(F.concat(F.lit(f"{name}:"), F.col("rep").cast("string")).alias("fit"), F.col("song_id").alias("key"), "fold", F.col("label").alias("y"), numbers(columns).alias("x"), "own")

    mean = coded.select("rep", "fold", "song_id", F.col("mean_enc").alias("e"))
    cuts = {name: edges(known.select(F.lit(name).alias("fit"), numbers(columns).alias("x")), "fit", "x", p.bins).get(name, []) for name, columns in sets.items()}  # all fits of a set have the same songs
    firsts = [asked(name, columns, mean) for name, columns in sets.items()]
    first = stage(fit_folds(stage(_union(firsts), "firsts"), folds, p, cuts={f"{name}:{rep}": cuts[name] for name in sets for rep in range(reps)}), "first")
    unknown = rows.filter("label is null").repartition(-(-rows.count() // SONGS) or 1, "song_id")
    artists = unknown.select(F.lit(None).cast("long").alias("song_id"), "artist").distinct()
    means = fold_encodings(artists, known.select("song_id", "artist", "label"), reps, folds).groupBy(F.col("artist").alias("__of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "fold", "mean_enc"))), lambda x: x["mean_enc"]).alias("means"))
    guessed = stage(_guessed(unknown.join(means, unknown["artist"].eqNullSafe(F.col("__of"))), first, sets, folds, p), "guessed")

    final = []
    for name, columns in sets.items():
        final += [asked(f"{name}|mean", columns, mean), asked(f"{name}|shrink", columns, coded.select("rep", "fold", "song_id", F.col("shrink_enc").alias("e")))]
        own = guessed.filter(F.col("feature_set") == name).drop("feature_set")
        both = coded.join(own, ["rep", "fold", "artist"], "left").select("rep", "fold", "song_id", F.coalesce(F.try_divide(F.col("s") + F.coalesce("sp", F.lit(0.0)), F.col("n") + F.coalesce("np", F.lit(0))), "g").alias("e"))
        final.append(asked(f"{name}|semi", columns, both))
    ready = stage(_union(final), "fits")
    models = fit_folds(ready, folds, p, cuts={f"{name}|{encoder}:{rep}": cuts[name] for name in sets for encoder in ("mean", "shrink", "semi") for rep in range(reps)})
    found = score(ready.select("fit", "fold", "y", F.concat("x", F.array(F.element_at("own", F.col("fold") + 1))).alias("x")), models, p)
    each = found.groupBy("fit").agg(F.corr("predicted", "y").alias("r"))
    parts = F.split(F.substring_index("fit", ":", 1), r"\|")
    return each.groupBy(parts[0].alias("feature_set"), parts[1].alias("encoder")).agg(F.avg("r").alias("r"), F.stddev_pop("r").alias("spread"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


TRAJECTORY = ["level", "c1", "c2", "c3", "c4", "slope", "accel", "dsl", "familiarity", "age"]


def line_out_of_fold(rows: DataFrame, columns: list[str], label: str, fold: str = "fold") -> DataFrame:
    """`rows` with `predicted` by least squares on all other folds (columns that say the same share
    their weight). The products of columns are summed by fold in one pass; what is solved then has
    the size of the columns, however many rows there are."""
    names = [*columns, "1"]
    one = rows.withColumn("1", F.lit(1.0))
    cell = lambda a, b: F.sum(F.col(f"`{a}`").cast("double") * F.col(f"`{b}`").cast("double"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = one.groupBy(fold).agg(*(cell(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)), *(cell(a, label).alias(f"y{i}") for i, a in enumerate(names))).collect()  # a row for each fold
    total = np.array([[r[c] or 0.0 for c in (*(f"p{i}" for i in range(len(pairs))), *(f"y{i}" for i in range(len(names))))] for r in sums]).reshape(len(sums), -1)
    chosen = F.lit(None).cast("double")
    for r, own in zip(sums, total, strict=True):
        rest = total.sum(0) - own
        gram = np.zeros((len(names), len(names)))
        for v, (a, b) in zip(rest, pairs, strict=False):
            gram[names.index(a), names.index(b)] = gram[names.index(b), names.index(a)] = v
        size = np.sqrt(np.maximum(gram.diagonal(), 1e-300))
        weights = np.linalg.pinv(gram / np.outer(size, size), rcond=1e-10, hermitian=True) @ (rest[len(pairs) :] / size) / size
        value = F.lit(float(weights[-1]))
        for c, w in zip(columns, weights, strict=False):
            value = value + F.lit(float(w)) * F.col(c).cast("double")
        chosen = F.when(F.col(fold) == r[fold], value).otherwise(chosen)
    return rows.withColumn("predicted", chosen)


def _boosted_out_of_fold(rows: DataFrame, sets: dict[str, list[str]], label: str, p: Boosting, folds: int = 5) -> DataFrame:
    """(feature_set, y, predicted) of every row, each by the trees of the other folds."""
    ready = _union([rows.select(F.lit(name).alias("fit"), "key", "fold", F.col(label).cast("double").alias("y"), numbers(columns).alias("x"), F.lit(None).cast("array<double>").alias("own")) for name, columns in sets.items()])
    return score(ready.select("fit", "fold", "y", "x"), fit_folds(ready, folds, p), p).select(F.col("fit").alias("feature_set"), "y", "predicted")


def panel_models(panel: DataFrame, p: Boosting = PANEL) -> DataFrame:
    """(model, feature_set, n, r2, mae): the next weeks' plays from the trajectory, the trajectory
    and affinity (column `A`), and affinity alone, by a line and by boosting, all on the same folds
    of songs and on snapshots whose song has an affinity."""
    rows = stage(panel.filter("A is not null").withColumn("fold", fold_of("song_id")).withColumn("key", F.struct("song_id", "T")), "panel")
    sets = {"trajectory": TRAJECTORY, "trajectory and A": [*TRAJECTORY, "A"], "A": ["A"]}
    lines = [line_out_of_fold(rows, columns, "future").select(F.lit("line").alias("model"), F.lit(name).alias("feature_set"), F.col("future").cast("double").alias("y"), "predicted") for name, columns in sets.items()]
    trees = _boosted_out_of_fold(rows, sets, "future", p).withColumn("model", F.lit("boosted"))
    found = _union([*lines, trees.select("model", "feature_set", "y", "predicted")])
    mean = rows.agg(F.avg("future").alias("m"))
    return found.crossJoin(F.broadcast(mean)).groupBy("model", "feature_set").agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum((F.col("y") - F.col("predicted")) ** 2), F.sum((F.col("y") - F.col("m")) ** 2))).alias("r2"), F.avg(F.abs(F.col("y") - F.col("predicted"))).alias("mae"))


def revival(panel: DataFrame, p: Boosting = REVIVAL, least: int = 50) -> DataFrame:
    """(feature_set, n, revived, auc, rho): how well quiet songs that come back are told from those
    that don't, with affinity and without; rho is the rank correlation of affinity and coming back.
    No rows where all or none come back, or no more than `least` snapshots are quiet."""
    quiet = panel.filter("level = 0 and A is not null").withColumns({"back": (F.col("future") > 0).cast("int"), "fold": fold_of("song_id"), "key": F.struct("song_id", "T")})
    quiet = stage(quiet, "quiet")
    counts = quiet.agg(F.count("*").alias("n"), F.coalesce(F.sum("back"), F.lit(0)).alias("back")).first()
    base = ["dsl", "familiarity", "age"]
    out = quiet.sparkSession.createDataFrame([], "feature_set string, n long, revived double, auc double, rho double")
    if counts["n"] <= least or counts["back"] in (0, counts["n"]):
        return out
    sets = {"trajectory": base, "trajectory and A": [*base, "A"]}
    scored = stage(_boosted_out_of_fold(quiet, sets, "back", p), "scored")
    rho = lifecycle.spearman(quiet, "A", "back", []).select("rho")
    for name in sets:
        found = lifecycle.mann_whitney(scored.filter(F.col("feature_set") == name).withColumn("one", F.col("y") > 0), "predicted", "one")
        out = out.unionByName(found.crossJoin(F.broadcast(rho)).select(F.lit(name).alias("feature_set"), (F.col("n1") + F.col("n0")).alias("n"), (F.col("n1") / (F.col("n1") + F.col("n0"))).alias("revived"), "auc", "rho"))
    return out
