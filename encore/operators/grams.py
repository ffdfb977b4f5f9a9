"""Text joins without all pairs: containment and similarity by runs of characters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grams(s: Column, n: int) -> Column:
    """All runs of n characters; a shorter text is its own one."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n))))


def contained(short: DataFrame, long: DataFrame, by: Sequence[str] = (), n: int = 3) -> DataFrame:
    """Pairs of `short` (sid, *by, s) and `long` (lid, *by, l) that agree in `by` and where l holds s.

    A text that holds another has all runs of it, so of each short text the run that fewest long
    ones have is looked up. Texts shorter than a run are looked up by what they are among the runs of
    that length. Null and empty texts hold nothing and are held by nothing. Runs are many more than
    their texts, so neither side is ever broadcast."""
    keys = [*by, "g"]
    runs = long.filter("l != ''").select("*", F.explode(F.array_distinct(F.concat(*(grams(F.col("l"), k) for k in range(1, n + 1))))).alias("g"))
    counts = runs.groupBy(*keys).agg(F.count("*").alias("k"))
    asked = short.filter("s != ''").select("*", F.explode(grams(F.col("s"), n)).alias("g")).join(counts.hint("merge"), keys, "left")
    # a run that no long text has rules the short one out: it comes first and finds nothing
    rarest = asked.groupBy(*short.columns).agg(F.min_by("g", F.struct(F.coalesce("k", F.lit(0)), "g")).alias("g"))
    return rarest.join(runs.hint("merge"), keys).filter(F.contains("l", "s")).drop("g")


def may_be_similar(one: DataFrame, two: DataFrame, least: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of `one` (*by, x) and `two` (*by, y) that agree in `by` and may reach a Ratcliff-Obershelp
    ratio of `least` (over .8); none that do is missing, equal texts aside. Texts under 3 characters are
    similar only if equal.

    Let S be both lengths. A ratio of r needs r S / 2 matched characters in runs, and between two
    runs one that is not matched, so at most (1 - r) S + 1 runs: at least (1.5 r - 1) S - 1 pairs of
    neighbouring characters are common. The other text has r / (2 - r) of the length at least, which
    bounds S from below; so the rarest pairs, all but that many and one, must meet."""
    if least <= 0.8:
        raise ValueError("similarities up to .8 don't ask for enough common characters")
    share = 1 + least / (2 - least)

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        s = F.col(name)
        pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
        numbered = F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda h: h == g)).cast("string")))  # the k-th of a pair is a thing of its own
        rows = df.select(*by, name).distinct().filter(F.length(s) >= 3).withColumn("g", F.explode(numbered))
        return rows.withColumn("need", F.greatest(F.lit(1), F.ceil((1.5 * least - 1) * share * F.length(s) - 1 - 1e-9)))

    a, b = prefixes(one, "x"), prefixes(two, "y")
    counts = a.select("g").unionByName(b.select("g")).groupBy("g").agg(F.count("*").alias("k"))

    def first(rows: DataFrame, name: str) -> DataFrame:
        own = Window.partitionBy(*by, name)
        placed = rows.join(counts, "g").withColumns({"at": F.row_number().over(own.orderBy("k", "g")), "all": F.count("*").over(own)})
        return placed.filter(F.col("at") <= F.col("all") - F.col("need") + 1).select(*by, name, "g")

    met = first(a, "x").join(first(b, "y").hint("merge"), [*by, "g"]).select(*by, "x", "y").distinct()
    longest = F.greatest(F.length("x"), F.length("y"))
    return met.filter((F.col("x") != F.col("y")) & (2.0 * F.least(F.length("x"), F.length("y")) >= least * (F.length("x") + F.length("y"))) & (longest >= 3))
