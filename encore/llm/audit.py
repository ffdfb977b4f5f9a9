"""What filters do to each other: every order of a few filters, audited from masks in long form.

A document is reduced to a mask of the filters it fails; documents are counted by part and mask, so
what follows has a few rows for each part and mask, however many documents there are. Those cells
are unpivoted against every step of every order. A running bit-or over a cell's earlier steps tells
whether it is gone already; conditional sums of the cells, and sums over all orders of a filter,
give the figures.

Null texts count as empty. A null part is the empty string. Several labels of one document count as
one that has every mark any of them has; labels with a null id mark nothing. Repeated rows count
each. Copies are told by the whole text (SHA-256): a document fails as a copy where a smaller id has
its text; a null id is neither smaller than another nor has it a smaller one, and rows of one id
aren't copies of each other. An empty table has no parts, so no rows. Columns of any other name
may be there, they aren't read."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.common import UPPER

FILTERS = "ABCDE"
_WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails: A under 200 words, B half of its words repeated, C over 3 % capitals,
    D any of `#$%&*|`. Words are runs without ASCII white space."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def failure_masks(docs: DataFrame, failures: list[Column], doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, mask, *carry): bit k for the k-th of `failures`, the next bit for copies of a smaller id.

    The least id of each text is found by an aggregate and comes back to its row by text and id, so
    a text that a third of all rows share meets nowhere."""
    mask = F.lit(0)
    for k, failed in enumerate(failures):
        mask = mask + F.when(failed, 1 << k).otherwise(0)
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("h"), mask.alias("mask"), *(c.alias(k) for k, c in (carry or {}).items()))
    first = slim.filter("id is not null").groupBy("h").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return slim.join(first, ["h", "id"], "left").select("id", (F.col("mask") + F.when(copy, 1 << len(failures)).otherwise(0)).alias("mask"), *(carry or {}))


def interactions(masks: DataFrame, part: str, filters: str, marks: dict[str, str]) -> DataFrame:
    """One row for each part, order of `filters` and step. `masks`: rows (part, mask, boolean marks);
    `marks`: the name a mark's losses get, by its column."""
    cells = masks.groupBy(part, "mask").agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in marks))
    bit = {f: 1 << k for k, f in enumerate(filters)}
    steps = F.array(*(F.struct(F.lit("".join(o)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(f).alias("filter"), F.lit(bit[f]).alias("bit")) for o in permutations(filters) for k, f in enumerate(o)))
    long = cells.select("*", F.explode(steps).alias("s")).select(part, "mask", "n", *marks, "s.*")
    before = Window.partitionBy(part, "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(before), F.lit(0)) != 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    flags = long.withColumns({"gone": gone, "fails": fails})

    def total(amount: str, when: str) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(when), F.col(amount))), F.lit(0))

    figures = flags.groupBy(part, "filter_order", "step", "filter").agg(
        total("n", "not gone and not fails").alias("kept"),
        total("n", "not gone and fails").alias("removed"),
        total("n", "gone and fails").alias("redundant"),
        total("n", "mask = bit").alias("unique_fails"),
        *(total(c, "not gone and fails").alias(name) for c, name in marks.items()),
    )
    return figures.withColumn("shapley", F.sum("removed").over(Window.partitionBy(part, "filter"))).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of filters A to E over whole texts, by `part`; losses of documents labelled good
    (quality 1) and toxic (toxic 1)."""
    masks = failure_masks(docs, text_failures(F.col(text)), doc_id, text, {"part": F.coalesce(F.col(part), F.lit(""))})
    marked = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("bad"))
    rows = masks.join(marked.filter("good or bad"), "id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad"))
    return interactions(rows, "part", FILTERS, {"good": "good_lost", "bad": "toxic_lost"})
