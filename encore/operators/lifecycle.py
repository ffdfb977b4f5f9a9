"""How a song's plays spread over its life: ordinals, intervals, curves, snapshots, rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.labels import state_label
from encore.functions.stats import mann_whitney_p, spearman_p, wilcoxon_p
from encore.functions.times import DAY, days
from encore.operators import features, order
from encore.staging import stage


def play_ordinal(plays: DataFrame) -> DataFrame:
    """`plays` with `gidx`, the play's number from 0 in the order of the whole log.

    A window over the whole log would run in one task. Plays are numbered inside ranges of the
    order, and a running count of ranges (few rows, however long the log) gives each its start."""
    return _ordinal(order.ranges(plays, "ts", "tie"))


def _ordinal(ranges: DataFrame) -> DataFrame:
    sizes = ranges.groupBy("part").agg(F.count("*").alias("k"))
    starts = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("ts", "tie"))
    return ranges.withColumn("__own", own).join(F.broadcast(starts), "part").withColumn("gidx", F.col("start") + F.col("__own") - 1).drop("part", "start", "__own")


def exposure_intervals(plays: DataFrame) -> DataFrame:
    """Per play from a song's second on: plays of the log since the song's last one, and its number
    among the song's plays."""
    own = Window.partitionBy("song_id").orderBy("gidx")
    ranges = order.ranges(plays.filter(F.col("song_id").isNotNull()).select("song_id", "ts", "tie"), "ts", "tie")
    numbered = _ordinal(ranges).select("song_id", "gidx").repartition(order.tasks_for(ranges), "song_id")
    rows = numbered.select("song_id", "gidx", (F.col("gidx") - F.lag("gidx").over(own)).alias("interval"), (F.row_number().over(own) - 1).alias("familiarity"))
    return rows.filter(F.col("interval").isNotNull())


def life_span(plays: DataFrame, least: int = 16, least_days: float = 7.0) -> DataFrame:
    """Songs with enough plays over enough days: first, last, number of plays."""
    spans = plays.filter(F.col("song_id").isNotNull()).groupBy("song_id").agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("tl"))
    return spans.filter((F.col("n") >= least) & (days(F.col("t0"), F.col("tl")) >= least_days))


def cumulative_curve(plays: DataFrame, points: int = 21) -> DataFrame:
    """(song_id, g, y): the share of a song's plays up to each of `points` parts of its life."""
    u = (F.unix_timestamp("ts") - F.unix_timestamp("t0")) * (points - 1)
    length = F.unix_timestamp("tl") - F.unix_timestamp("t0")
    rows = plays.join(life_span(plays), "song_id").select("song_id", "n", F.ceil(u / length).alias("from"))
    steps = rows.groupBy("song_id", "from").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    songs = steps.groupBy("song_id").agg(F.first("n").alias("n"))
    grid = songs.select("song_id", "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"))
    run = F.sum(F.coalesce("k", F.lit(0))).over(Window.partitionBy("song_id").orderBy("g"))
    return grid.join(steps.select("song_id", F.col("from").cast("int").alias("g"), "k"), ["song_id", "g"], "left").select("song_id", "g", (run / F.col("n")).alias("y"))


def life_bins(plays: DataFrame, bins: int = 5, least: int = 8) -> DataFrame:
    """(song_id, bin, mean_interval): mean interval in each fifth of a song's intervals. Bins are
    closed at both ends, so an interval on a border counts in both; songs with an empty bin go."""
    own = Window.partitionBy("song_id")
    rows = exposure_intervals(plays).select("song_id", "interval", (F.row_number().over(own.orderBy("familiarity")) - 1).alias("k"), F.count("*").over(own).alias("n")).filter(F.col("n") >= least)
    within = rows.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).filter(f"bin * (n - 1) <= {bins} * k and {bins} * k <= (bin + 1) * (n - 1)")
    means = within.groupBy("song_id", "bin").agg(F.avg("interval").alias("mean_interval"))
    return means.withColumn("found", F.count("*").over(own)).filter(F.col("found") == bins).drop("found")


def snapshots(plays: DataFrame, every: int = 14, start: int = 90, ahead: int = 28, least: int = 5, past: int = 3) -> DataFrame:
    """The panel (song, T): four weekly counts before T, their level, slope and acceleration, days
    since the last play, plays so far, age, and the plays of the `ahead` days after.

    Grid rows and plays are one ordered set; counts are RANGE windows over it, so no song's plays
    are joined with its grid."""
    done = features.completed(plays).filter(F.col("song_id").isNotNull()).select("song_id", F.unix_timestamp("ts").alias("t"))
    bounds = done.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    songs = done.groupBy("song_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("song_id")
    grid = bounds.filter(f"hi - lo > {(start + ahead) * DAY}").select(F.explode(F.sequence(F.col("lo") + start * DAY, F.col("hi") - ahead * DAY - 1, F.lit(every * DAY))).alias("t"))
    rows = done.join(songs, "song_id", "left_semi").withColumn("play", F.lit(1)).unionByName(songs.crossJoin(F.broadcast(grid)).withColumn("play", F.lit(0)))
    own = Window.partitionBy("song_id").orderBy("t")
    week = 7 * DAY

    def count(low: int, high: int) -> Column:
        return F.coalesce(F.sum("play").over(own.rangeBetween(low, high)), F.lit(0))

    before = own.rangeBetween(Window.unboundedPreceding, -1)
    at_play = F.when(F.col("play") == 1, F.col("t"))
    cols = {f"c{5 - k}": count(-k * week, -(k - 1) * week - 1) for k in range(4, 0, -1)}
    cols |= {"future": count(0, ahead * DAY - 1), "familiarity": F.coalesce(F.sum("play").over(before), F.lit(0)), "last": F.max(at_play).over(before), "first": F.min(at_play).over(before)}
    out = rows.withColumns(cols).filter(f"play = 0 and familiarity >= {past} and first < t")
    return out.selectExpr("song_id", "t as T", "c1", "c2", "c3", "c4", "c1 + c2 + c3 + c4 as level", "c4 + c3 - c2 - c1 as slope", "(c4 - c3) - (c2 - c1) as accel", f"(t - last) / {DAY}D as dsl", "familiarity", f"(t - first) / {DAY}D as age", "future")


def state_distribution(panel: DataFrame) -> DataFrame:
    return features.distribution(panel.withColumn("state", state_label(F.col("level"), F.col("future"))), "state")


def average_rank(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """`rows` with the value's rank in its group; equal values share the mean of their ranks.
    Without groups, see `overall_rank`."""
    if not by:
        return order.overall_rank(rows, value, name)
    group = Window.partitionBy(*by)
    return rows.withColumn(name, F.rank().over(group.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0)


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation by group with its two-sided p; null where one side is constant."""
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(rows, x, by, "rx"), y, by, "ry")
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("rx", "ry"), F.sqrt(F.var_pop("rx") * F.var_pop("ry"))).alias("rho"), (F.min(x) < F.max(x)).alias("vx"), (F.min(y) < F.max(y)).alias("vy"))
    return out.withColumn("rho", F.when(F.col("vx") & F.col("vy"), F.col("rho"))).withColumn("p", spearman_p(F.col("rho"), F.col("n"))).drop("vx", "vy")


def cooling_slope(plays: DataFrame, least: int = 8) -> DataFrame:
    """Rank correlation of a song's play number with its intervals: above 0 it is heard less often."""
    return spearman(exposure_intervals(plays), "familiarity", "interval", ["song_id"]).filter(F.col("n") >= least).drop("p")


def partial_spearman(rows: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row: rank correlation of x and y given z."""
    one = rows.select(x, y, z)
    for c in (x, y, z):
        one = order.overall_rank(one, c, f"r_{c}")
    r = one.agg(F.corr(f"r_{x}", f"r_{y}").alias("xy"), F.corr(f"r_{x}", f"r_{z}").alias("xz"), F.corr(f"r_{y}", f"r_{z}").alias("yz"))
    return r.select("xy", ((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("partial"))


def wilcoxon(rows: DataFrame, value: str) -> DataFrame:
    """Signed-rank statistic and its two-sided p: the lesser sum of ranks of positive and negative
    values (no zeros)."""
    some = rows.filter((F.col(value) != 0) & F.col(value).isNotNull()).select(F.col(value).alias("v"), F.abs(value).alias("a"))
    ranked = order.overall_rank(some, "a", "r", "k")
    found = ranked.agg(F.count("*").alias("n"), F.least(F.sum(F.when(F.col("v") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("v") < 0, F.col("r")).otherwise(0.0))).alias("W"), F.sum(F.col("k").cast("double") ** 2 - 1).alias("ties"))
    return found.select("n", "W", wilcoxon_p(F.col("W"), F.col("n"), F.col("ties")).alias("p"))


def mann_whitney(rows: DataFrame, value: str, group: str) -> DataFrame:
    """U of the rows where `group` is true, the AUC it means, and its two-sided p."""
    some = rows.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(value, F.col(group).cast("boolean").alias("one"))
    r = order.overall_rank(some, value, "r", "k").agg(F.sum(F.when(F.col("one"), F.col("r")).otherwise(0.0)).alias("s"), F.count_if("one").alias("n1"), F.count_if(~F.col("one")).alias("n0"), F.sum(F.col("k").cast("double") ** 2 - 1).alias("ties"))
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0
    return r.select("n1", "n0", u.alias("U"), F.try_divide(u, F.col("n1") * F.col("n0")).alias("auc"), mann_whitney_p(u, F.col("n1"), F.col("n0"), F.col("ties")).alias("p"))


def r_squared(rows: DataFrame, y: str, predicted: str) -> DataFrame:
    mean = rows.agg(F.avg(y).alias("m"))
    return rows.crossJoin(F.broadcast(mean)).agg((1 - F.sum((F.col(y) - F.col(predicted)) ** 2) / F.sum((F.col(y) - F.col("m")) ** 2)).alias("r2"), F.avg(F.abs(F.col(y) - F.col(predicted))).alias("mae"))


def holdout(plays: DataFrame, at: Column, least: int = 8) -> DataFrame:
    """Cooling slopes before a moment beside the plays after it (0 if none)."""
    before, after = plays.filter(F.col("ts") < at), plays.filter(F.col("ts") >= at)
    future = after.groupBy("song_id").agg(F.count("*").alias("future_plays"))
    return cooling_slope(before, least).join(future, "song_id", "left").withColumn("future_plays", F.coalesce("future_plays", F.lit(0)))


def holdout_groups(held: DataFrame) -> DataFrame:
    """(n1, n0, mean1, mean0, U, auc, p) of a `holdout`: later plays of the quarter of songs that cool
    most against the quarter that cools least. A song on both borders is in both groups, as both
    quarters are closed."""
    some = stage(held.filter("rho is not null"), "held")
    cut = order.quantiles(some, "rho", [0.25, 0.75]).agg(F.max(F.when(F.col("share") == 0.25, F.col("q"))).alias("lo"), F.max(F.when(F.col("share") == 0.75, F.col("q"))).alias("hi"))
    near = some.crossJoin(F.broadcast(cut)).select("future_plays", F.explode(F.array_compact(F.array(F.when(F.col("rho") >= F.col("hi"), True), F.when(F.col("rho") <= F.col("lo"), False)))).alias("cools"))
    near = stage(near, "quarters")
    means = near.agg(F.avg(F.when(F.col("cools"), F.col("future_plays"))).alias("mean1"), F.avg(F.when(~F.col("cools"), F.col("future_plays"))).alias("mean0"))
    return mann_whitney(near, "future_plays", "cools").crossJoin(F.broadcast(means)).select("n1", "n0", "mean1", "mean0", "U", "auc", "p")


def sessions(plays: DataFrame, gap_seconds: int = 1800, skip_seconds: int = 30) -> DataFrame:
    """Plays by user with their session's number, and whether the next play came so soon that this
    one was skipped."""
    own = Window.partitionBy("user_id").orderBy("ts", "tie")
    since = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(own))
    until = F.unix_timestamp(F.lead("ts").over(own)) - F.unix_timestamp("ts")
    rows = plays.withColumns({"starts": F.coalesce((since > gap_seconds).cast("int"), F.lit(1)), "gap_skip": F.coalesce((until < skip_seconds).cast("int"), F.lit(0))})
    return rows.withColumn("session", F.sum("starts").over(own.rowsBetween(Window.unboundedPreceding, 0)))
