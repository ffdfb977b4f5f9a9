"""Ranked playlists: blends, gates, caps, quotas, samples, slots and the order of play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.times import uniform
from encore.functions.vectors import dot, unit
from encore.operators.order import quantiles

#: Exponents of A and 1 + R by mode.
MODES = {"comfort": (1.0, 0.0), "balanced": (1.0, 1.0), "now": (1.0, 2.0)}


def mode_playlist(songs: DataFrame, mode: str = "balanced", total: int = 20, n_new: int = 4) -> DataFrame:
    """`songs` (song_id, A, R, familiarity): the best known songs by A^a (1+R)^b, then the best of
    the little known (familiarity up to the 30 % point) by A that aren't in yet."""
    a, b = MODES[mode]
    q30 = quantiles(songs, "familiarity", [0.3]).select(F.col("q").alias("q30"))
    rows = songs.crossJoin(F.broadcast(q30)).withColumn("s", F.pow("A", F.lit(a)) * F.pow(1 + F.col("R"), F.lit(b)))
    cols = ["song_id", "A", "R", "s", "familiarity"]
    main = rows.filter("familiarity > q30").orderBy(F.desc("s"), "song_id").limit(total - n_new).select(*cols, F.lit("main").alias("slot"))
    fresh = rows.filter("familiarity <= q30").join(main.select("song_id"), "song_id", "left_anti").orderBy(F.desc("A"), "song_id").limit(n_new).select(*cols, F.lit("new").alias("slot"))
    return main.unionByName(fresh)


def seed_recommend(songs: DataFrame, seed_id: Column, count: int = 20, gate: int = 40, alpha: float = 1.0, beta: float = 0.0, sample: str | None = None) -> DataFrame:
    """(pos, song_id, similarity, score): the seed, then the best of its `gate` nearest songs by
    sim x A^alpha x (1+R)^beta. With a `sample` seed, count - 1 of the best twice as many are drawn
    without replacement, by their score. `songs`: song_id, v, A, R."""
    rows = songs.withColumn("u", unit(F.col("v")))
    seed = rows.filter(F.col("song_id") == seed_id).select(F.col("u").alias("su")).limit(1)
    near = rows.filter(F.col("song_id") != seed_id).crossJoin(F.broadcast(seed)).withColumn("similarity", dot(F.col("u"), F.col("su")))
    near = near.orderBy(F.desc("similarity"), "song_id").limit(gate)
    ranked = near.withColumn("score", F.col("similarity") * F.pow("A", F.lit(alpha)) * F.pow(1 + F.col("R"), F.lit(beta)))
    best = weighted_sample(ranked.orderBy(F.desc("score"), "song_id").limit(2 * (count - 1)), "score", count - 1, sample) if sample else ranked.orderBy(F.desc("score"), "song_id").limit(count - 1)
    placed = best.select("song_id", "similarity", "score").withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "song_id")) + 1)  # under `count` rows
    own = songs.filter(F.col("song_id") == seed_id).limit(1).select("song_id", F.lit(1.0).alias("similarity"), F.lit(None).cast("double").alias("score"), F.lit(1).alias("pos"))
    return placed.unionByName(own)


def weighted_sample(rows: DataFrame, weight: str, k: int, seed: str, key: str = "song_id") -> DataFrame:
    """k rows drawn without replacement, by weight: the least of -ln(u) / w (the same law as one
    draw after another). u is a hash, so the draw can be repeated."""
    draw = -F.log(F.greatest(uniform(seed, F.col(key)), F.lit(1e-12))) / F.greatest(F.col(weight), F.lit(1e-9))
    return rows.orderBy(draw, key).limit(k)


def artist_cap(rows: DataFrame, cap: int, weight: str = "weight", key: str = "song_id") -> DataFrame:
    """The rows that stay when, best first, an artist may have `cap` of them."""
    own = Window.partitionBy("artist").orderBy(F.desc(weight), key)
    return rows.withColumn("__rn", F.row_number().over(own)).filter(F.col("__rn") <= cap).drop("__rn")


def cap_for(size: int) -> int:
    return max(2, int(0.2 * size))


def quota_fill(rows: DataFrame, quotas: dict[str, int], n: int, tier: str = "tier", score: str = "score", key: str = "song_id") -> DataFrame:
    """Up to its quota from each tier, the rest by score from what is left; of a tier no more than
    its first n can be among them, so tasks keep those only."""
    rank = F.row_number().over(Window.partitionBy(tier).orderBy(F.desc(score), key))
    quota = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col(tier)), F.lit(0))
    best = rows.withColumn("__rn", rank).filter(F.col("__rn") <= n)
    return best.withColumn("in_quota", F.col("__rn") <= quota).drop("__rn").orderBy(F.desc("in_quota"), F.desc(score), key).limit(n)


def slots(main: DataFrame, found: DataFrame) -> DataFrame:
    """(song_id, pos): discoveries (rank from 0) at fixed places of the playlist, the main songs
    around them. First place min(4, total - 1), then every max(3, (total - 1) div (d + 1))."""
    sizes = main.agg(F.count("*").alias("m")).crossJoin(F.broadcast(found.agg(F.count("*").alias("d"))))
    sizes = sizes.selectExpr("m", "d", "least(4, m + d - 1) as first", "greatest(3, (m + d - 1) div (d + 1)) as every")
    placed = found.crossJoin(F.broadcast(sizes)).selectExpr("song_id", "least(first + rank * every, m + rank) as pos", "true as is_new")
    # a main song of rank r stands after as many discoveries as have fewer than r + 1 songs before
    before = placed.select((F.col("pos") - F.row_number().over(Window.orderBy("pos")) + 1).alias("songs_before"))  # a few slots
    marks = before.agg(F.collect_list("songs_before").alias("marks"))
    moved = main.crossJoin(F.broadcast(marks)).select("song_id", (F.col("rank") + F.size(F.filter("marks", lambda x: x <= F.col("rank")))).cast("long").alias("pos"), F.lit(False).alias("is_new"))
    return moved.unionByName(placed.withColumn("pos", F.col("pos").cast("long")))


def apart(artists: list, passes: int = 3) -> list[int]:
    """The order in which neighbours of one artist are parted: such a row changes places with the
    first later one of another artist that would not stand beside its own there, unless none does;
    at most `passes` times over the list."""
    order = list(range(len(artists)))
    at = lambda k: artists[order[k]]
    for _ in range(passes):
        moved = False
        for i in range(1, len(order)):
            if at(i) != at(i - 1):
                continue
            free = (j for j in range(i + 1, len(order)) if at(j) != at(i) and at(j) != at(j - 1) and (j + 1 == len(order) or at(j) != at(j + 1)))
            if (j := next(free, None)) is not None:
                order[i], order[j], moved = order[j], order[i], True
        if not moved:
            break
    return order


def play_order(playlist: DataFrame, by: str = "user_id", passes: int = 3) -> DataFrame:
    """Each playlist's rows (pos, song_id, artist) with neighbours of one artist apart where `apart`
    does it. A playlist is one group."""

    def run(pdf):
        pdf = pdf.sort_values(["pos", "song_id"], ignore_index=True)
        out = pdf.iloc[apart([None if x != x else x for x in pdf["artist"]], passes)].reset_index(drop=True)
        return out.assign(pos=range(len(out)))

    return playlist.groupBy(by).applyInPandas(run, playlist.schema)


def interleave(rows: DataFrame, by: str, weight: str = "weight", key: str = "song_id", seed: str = "dj") -> DataFrame:
    """`rows` with `pos`: thirds by weight, shuffled inside, dealt high, low, middle in turn."""
    own = Window.partitionBy(by)
    third = F.ntile(3).over(own.orderBy(F.desc(weight), key))
    turn = F.when(F.col("third") == 1, 0).when(F.col("third") == 3, 1).otherwise(2)
    tiers = rows.withColumn("third", third).withColumn("within", F.row_number().over(Window.partitionBy(by, "third").orderBy(uniform(seed, F.col(key)), key)))
    return tiers.withColumn("pos", F.row_number().over(own.orderBy("within", turn)) - 1).drop("third", "within")


#: Exponents of affinity, momentum and context, and the share of discoveries, by preset.
PRESETS = {"default": (1.0, 1.0, 1.0, 0.20), "explore": (0.7, 0.5, 1.5, 0.40), "comfort": (1.5, 0.7, 0.8, 0.15)}
#: The preset `lgbm` adds up the foretold affinity (1..5, 2.5 if unknown) and context.
LGBM = (0.45, 0.55, 2.5, 0.20)


def mixed_weights(songs: DataFrame, preset: str = "default", jitter: float = 0.0, seed: str = "mix") -> DataFrame:
    """`songs` (affinity, momentum, context 0..100; for `lgbm` A) with the mixer's weight. Unknown
    affinity and momentum are .5, an unknown context is 100."""
    ctx = F.greatest(F.lit(0.01), F.coalesce("context", F.lit(100.0)) / 100.0)
    noise = uniform(seed, F.col("song_id")) * jitter if jitter else F.lit(0.0)
    if preset == "lgbm":
        wl, wc, unknown, _ = LGBM
        return songs.withColumn("weight", wl * F.coalesce("A", F.lit(unknown)) / 5.0 + wc * ctx + noise)
    wa, wm, wc, _ = PRESETS[preset]
    return songs.withColumn("weight", F.pow(F.coalesce("affinity", F.lit(0.5)), F.lit(wa)) * F.pow(F.coalesce("momentum", F.lit(0.5)), F.lit(wm)) * F.pow(ctx, F.lit(wc)) + noise)


def mixer(songs: DataFrame, discoveries: DataFrame, size: int = 20, preset: str = "default") -> DataFrame:
    """The playlist (pos, song_id, is_new): discoveries first under the artist cap, then the library
    by weight under the same cap; what was discovered is not taken twice."""
    cap = cap_for(size)
    n_new = max(1, int((LGBM if preset == "lgbm" else PRESETS[preset])[3] * size))
    new = artist_cap(discoveries, cap, "score").orderBy(F.desc("score"), "song_id").limit(n_new)
    used = new.groupBy("artist").agg(F.count("*").alias("used"))
    rows = mixed_weights(songs, preset).join(new.select("song_id"), "song_id", "left_anti").join(F.broadcast(used), "artist", "left")
    own = Window.partitionBy("artist").orderBy(F.desc("weight"), "song_id")
    left = size - new.count()  # at most a playlist's discoveries; what they lack the library fills
    main = rows.withColumn("rn", F.row_number().over(own) + F.coalesce("used", F.lit(0))).filter(F.col("rn") <= cap).orderBy(F.desc("weight"), "song_id").limit(left)
    ranked = lambda df, w: df.select("song_id", (F.row_number().over(Window.orderBy(F.desc(w), "song_id")) - 1).alias("rank"))  # noqa: E731  a playlist
    return slots(ranked(main, "weight"), ranked(new, "score"))


def uniform_of_best(rows: DataFrame, weight: str, seed: str, best: int = 20, key: str = "song_id") -> DataFrame:
    """One of the `best` rows by weight, each as likely; the draw is a hash and can be repeated."""
    return rows.orderBy(F.desc(weight), key).limit(best).orderBy(uniform(seed, F.col(key)), key).limit(1)


def ranked_by_file(songs: DataFrame, ranking: DataFrame) -> DataFrame:
    """`songs` that a ranking (place, title, artist, score) names, with their score; of rows of one
    name the last counts."""
    last = ranking.groupBy("title", "artist").agg(F.max_by("score", "place").alias("score"))
    return songs.join(last, ["title", "artist"])
