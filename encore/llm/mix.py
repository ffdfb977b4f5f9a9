"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree: domain, language, source. A token budget goes down the tree in proportion to
the weights of siblings. What a leaf can give is its tokens times `max_epochs`; what a child cannot
use goes to its siblings first, and only what a whole subtree cannot use reaches the siblings of its
ancestors. (Exact integer water-filling: children in the order of capacity by weight, the short
ones filled to capacity, the rest shares what is left.) A leaf's budget is so many full epochs, and
of one more epoch the prefix, in that epoch's seeded order, whose tokens fit.

Tokens are words without ASCII white space. Documents without a token (null or empty text) are
never selected; null domain, language and source count as the empty string; a null id takes part in
the order as such. Rows of one id in a leaf stand at one place of the order and are taken together
or not at all. A weight that is not given is 1; weights are positive integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.staging import stage

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order that make a bucket: running sums go over buckets, then inside one.
DIGITS = 3


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _weight(name: Column, weights: dict[str, int]) -> Column:
    found = F.lit(1)
    for key, value in sorted(weights.items()):
        found = F.when(name == key, value).otherwise(found)
    return found.cast("long")


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """`nodes` (cap, weight, and the parent's budget `b`) with their own `budget`."""
    group = Window.partitionBy(*parents)
    order = group.orderBy(F.col("cap") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, 0)
    big = lambda c: c.cast("decimal(19,0)")
    nodes = nodes.withColumns({"cum_cap": F.sum("cap").over(order), "cum_w": F.sum("weight").over(order), "all_w": F.sum("weight").over(group)})
    full = big(F.col("cap")) * big(F.expr("all_w - cum_w + weight")) <= big(F.col("weight")) * big(F.expr("b - cum_cap + cap"))
    nodes = nodes.withColumn("full", full)
    nodes = nodes.withColumns({"used": F.max(F.expr("if(full, cum_cap, 0L)")).over(group), "used_w": F.max(F.expr("if(full, cum_w, 0L)")).over(group)})
    rest = F.expr("(cast(weight as decimal(19,0)) * cast(b - used as decimal(19,0))) div cast(all_w - used_w as decimal(19,0))")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(rest).cast("long")).drop("cum_cap", "cum_w", "all_w", "full", "used", "used_w", "b")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaves (domain, lang, source, tokens)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above = leaves.groupBy().agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    above = above.select(F.least(F.coalesce(budget, F.lit(0)), F.coalesce("cap", F.lit(0))).cast("long").alias("b"))
    keys: list[str] = []
    for level in LEVELS:
        nodes = leaves.groupBy(*keys, level).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(above, keys) if keys else nodes.crossJoin(F.broadcast(above))  # one row
        nodes = _share(nodes.withColumn("weight", _weight(F.col(level), weights.get(level, {}))), keys, level)
        keys.append(level)
        above = nodes.select(*keys, F.col("budget").alias("b"))
    return leaves.join(above.withColumnRenamed("b", "budget"), keys).select(*keys, "tokens", "budget")


def mix(docs: DataFrame, domain: Column, budget_share: float = 0.5, weights: dict[str, dict[str, int]] | None = None, max_epochs: int = 2, seed: int = 7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of the documents that the mix takes."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), blank(domain).alias("domain"), blank(F.col("lang")).alias("lang"), blank(F.col("source")).alias("source"), n_tokens(F.col(text)).alias("n_tokens"))
    slim = stage(slim.filter("n_tokens > 0"), "mix")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, F.floor(F.col("tokens") * budget_share), weights or {}, max_epochs)
    plan = stage(plan.selectExpr(*LEVELS, "budget div tokens as epochs", "budget % tokens as rest"), "budgets")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = slim.join(plan, [*LEVELS]).withColumn("place", place).withColumn("bucket", F.substring("place", 1, DIGITS))
    cells = [*LEVELS, "bucket"]
    buckets = rows.groupBy(*cells).agg(F.sum("n_tokens").alias("own"))
    buckets = buckets.withColumn("upto", F.sum("own").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(buckets, cells)
    whole = rows.filter("upto <= rest or upto - own > rest").withColumn("more", F.expr("if(upto <= rest, 1L, 0L)"))
    cut = rows.filter("upto > rest and upto - own <= rest").withColumn("run", F.sum("n_tokens").over(Window.partitionBy(*cells).orderBy("place")))
    cut = cut.withColumn("more", F.expr("if(upto - own + run <= rest, 1L, 0L)")).drop("run")
    taken = whole.unionByName(cut).withColumn("copies", F.expr("epochs + more")).filter("copies > 0")
    return taken.select("doc_id", *LEVELS, "n_tokens", "copies")
