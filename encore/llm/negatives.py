"""Hard negatives by radix selection: rows of other labels just below an anchor's positives.

Vectors become integers (floor(scale * x)), so scores are integer inner products and a window of
scores can be searched like a number: tasks count the scores of a window by their leading digit,
the counts are summed, the digit that holds the k-th score is looked up, and the next pass counts
within it by the next digit. When few rows are left in the digit, or none is to come, the rows that
score high enough are gathered, ties by smaller id, and ranked. Positives are found the same way: a
window of all scores over rows of the anchor's label.

Scores are never stored. Rows are dealt to blocks, once; each pass sends the anchors to every block
and streams them past it, so a task holds a block and some anchors, and what it puts out for a
window is a count for each of its own first k scores at most: digits past a block's own k-th can't
hold the k-th of all. A hot label, or many equal vectors, are spread over blocks like other rows.

Rows with a null id, label or vector, or a component that is null or not finite, take no part. Of
several rows with one id the least (label, vector) counts. Rows meet only where their vectors are of
one length; an empty vector scores 0. A score must fit 63 bits, else the job fails with an error.
Anchors without a positive, or positives without a row in their window, give no rows, as does an
empty table. Other columns aren't read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.staging import drop_staged, stage

#: Rows of a block at most, and into how many blocks smaller tables go.
BLOCK_ROWS, LEAST_BLOCKS = 1 << 18, 48
#: Values of a digit in bits; a digit that holds no more rows than this needs no further pass.
DIGIT_BITS, FEW = 8, 16
#: Scores that a task computes at a time.
AT_ONCE = 1 << 21


def integer_rows(rows: DataFrame, vec_id: str, label: str, vector: str, scale: float) -> DataFrame:
    """(id, label, q) of the rows that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & fine)
    q = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    one = some.select(F.col(vec_id).cast("long").alias("id"), F.struct(F.col(label).cast("long").alias("label"), q.alias("q")).alias("r"))
    return one.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.q")


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


class Block:
    """Rows of a block, by (length, label), and what windows find among them."""

    def __init__(self, parts: list[pa.RecordBatch]):
        held: dict[tuple[int, int], list] = {}
        for part in parts:
            size, values = _ints(part.column("q"))
            ends = np.cumsum(size)
            for i, label, n, end in zip(part.column("id").to_pylist(), part.column("label").to_pylist(), size.tolist(), ends.tolist(), strict=True):
                held.setdefault((n, label), []).append((i, values[end - n : end]))
        self.groups = {}
        for key, rows in held.items():
            rows.sort(key=lambda r: r[0])
            self.groups[key] = (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).reshape(len(rows), key[0]))

    def others(self, n: int, label: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        found = [g for (m, x), g in self.groups.items() if m == n and (x == label) == same]
        if not found:
            return np.zeros(0, np.int64), np.zeros((0, n), np.int64)
        ids, q = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(ids, kind="stable")
        return ids[order], q[order]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, as exact floats where they are small, else as integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 1 << 63:
        raise ValueError("a score may take more than 63 bits")
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int32)
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 1 << 53 else a @ b.T


def _passed(rows: DataFrame, anchors: DataFrame, windows: DataFrame, blocks: int, same: bool, run, returns: str) -> DataFrame:
    """What `run(ids, scores, window columns)` gives for the anchors' windows in every block."""
    wide = windows.groupBy("anchor_id").agg(F.collect_list(F.struct("win", "top", "low", "k", "shift")).alias("w"))
    sent = anchors.join(wide, anchors["id"] == wide["anchor_id"]).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("turn"), "id", "label", "q", "w")
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("turn"), "id", "label", "q", F.lit(None).cast(wide.schema["w"].dataType).alias("w"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        at, block, near = None, None, {}
        for batch in batches:
            place = batch.column("block").to_numpy() * 2 + batch.column("turn").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                number, turn = divmod(int(place[lo]), 2)
                if number != at:
                    at, parts, block = number, [], None
                some = batch.slice(lo, hi - lo)
                if not turn:
                    parts.append(some.select(["id", "label", "q"]))
                    continue
                if block is None:
                    block, near, parts = Block(parts), {}, []
                yield from _meet(block, near, some, same, run)

    def _meet(block: Block, near: dict, some: pa.RecordBatch, same: bool, run) -> Iterator[pa.RecordBatch]:
        size, values = _ints(some.column("q"))
        end = np.cumsum(size)
        ids, labels = some.column("id").to_numpy(), some.column("label").to_numpy()
        many, inner = np.diff(some.column("w").offsets.to_numpy()), some.column("w").flatten()
        w = {name: inner.field(name).to_numpy() for name in ("win", "top", "low", "k", "shift")}
        last = np.cumsum(many)
        for n, label in sorted(set(zip(size.tolist(), labels.tolist(), strict=True))):
            if (n, label) not in near:
                near[n, label] = block.others(n, label, same)
            own, q = near[n, label]
            mine = np.flatnonzero((size == n) & (labels == label))
            step = max(1, AT_ONCE // max(1, len(own)))
            for k in range(0, len(mine) if len(own) else 0, step):
                now = mine[k : k + step]
                vectors = np.stack([values[end[i] - n : end[i]] for i in now]).reshape(len(now), n)
                found = scores(vectors, q)
                row = np.repeat(np.arange(len(now)), many[now])
                pick = np.concatenate([np.arange(last[i] - many[i], last[i]) for i in now])
                yield from run(ids[now], own, found, row, {name: x[pick] for name, x in w.items()}, same)

    return held.unionByName(sent).repartition(blocks, "block").sortWithinPartitions("block", "turn").mapInArrow(each, returns)


def _count(anchors, own, found, row, w, same) -> Iterator[pa.RecordBatch]:
    """(anchor_id, win, digit, n): counts of a window's scores by digit, up to its k-th here."""
    lowest = np.iinfo(found.dtype).min
    if same:
        found = np.where(own[None, :] == anchors[:, None], lowest, found)
    order = -np.sort(-found.astype(np.int64), axis=1)
    descending = -order
    out: list[tuple] = []
    for r in range(len(anchors)):
        for i in np.flatnonzero(row == r).tolist() if len(row) < 64 else range(np.searchsorted(row, r), np.searchsorted(row, r, "right")):
            top, low, k, shift = int(w["top"][i]), int(w["low"][i]), int(w["k"][i]), int(w["shift"][i])
            a, b = np.searchsorted(descending[r], -top), np.searchsorted(descending[r], -low, "right")
            if a >= b:
                continue
            if a + k < b:  # on to the end of the digit that holds the k-th
                edge = top - (((top - int(order[r, a + k - 1])) >> shift) + 1 << shift) + 1
                b = min(b, np.searchsorted(descending[r], -edge, "right"))
            digit, n = np.unique((top - order[r, a:b]) >> shift, return_counts=True)
            out += [(int(anchors[r]), int(w["win"][i]), int(d), int(m)) for d, m in zip(digit, n, strict=True)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["anchor_id", "win", "digit", "n"])


def _gather(anchors, own, found, row, w, same) -> Iterator[pa.RecordBatch]:
    """(anchor_id, win, score, id): a window's rows of this block that may be among its first k."""
    if same:
        found = np.where(own[None, :] == anchors[:, None], np.iinfo(found.dtype).min, found)
    for i in range(len(row)):
        line = found[row[i]]
        at = np.flatnonzero((line <= w["top"][i]) & (line >= w["low"][i]))
        if len(at):
            k = int(w["k"][i])
            if len(at) > k:  # ids are in order, so equal scores are too
                at = at[np.argsort(-line[at].astype(np.int64), kind="stable")[:k]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), anchors[row[i]])), pa.array(np.full(len(at), w["win"][i])), pa.array(line[at].astype(np.int64)), pa.array(own[at])], ["anchor_id", "win", "score", "id"])


def _merged(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows > 10_000:
            yield pa.Table.from_batches(held, schema).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held, schema).combine_chunks().to_batches()[0]


def select_top(rows: DataFrame, anchors: DataFrame, windows: DataFrame, blocks: int, same: bool) -> DataFrame:
    """(anchor_id, win, id, score, rank): the first k rows by score, then id, of each window.

    `windows`: (anchor_id, win, top, low, k), both ends included; `same` whether rows of the
    anchor's label or of all others are meant. `rows` and `anchors` are written tables."""
    shift = F.greatest(F.lit(0), F.length(F.conv((F.col("top") - F.col("low")).cast("string"), 10, 2)) - DIGIT_BITS).cast("long")
    state = stage(windows.select("anchor_id", "win", "top", "low", "k", F.col("k").alias("left"), F.col("top").alias("high"), F.lit(False).alias("ready")), "windows")
    while state.filter("not ready").limit(1).count():
        asked = state.filter("not ready").select("anchor_id", "win", F.col("high").alias("top"), "low", F.col("left").alias("k")).withColumn("shift", shift)
        counts = _passed(rows, anchors, asked, blocks, same, _count, "anchor_id long, win long, digit long, n long").groupBy("anchor_id", "win", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("anchor_id", "win").orderBy("digit"))
        last = counts.withColumn("upto", upto).join(asked.select("anchor_id", "win", F.col("k").alias("__left"), F.col("top").alias("__high"), F.col("low").alias("__low"), "shift"), ["anchor_id", "win"])
        held = last.filter("upto >= __left and upto - n < __left").select(
            "anchor_id", "win", F.expr("__left - (upto - n)").alias("__left"), F.expr("__high - shiftleft(digit, int(shift))").alias("__high"),
            F.expr("greatest(__low, __high - shiftleft(digit + 1, int(shift)) + 1)").alias("__low"), (F.col("n") <= FEW).alias("__few"),
        )
        new = state.join(held, ["anchor_id", "win"], "left")
        done = F.col("ready") | F.col("__high").isNull()  # fewer than k: all of the window
        before = state
        state = stage(new.select("anchor_id", "win", "top", F.coalesce("__low", "low").alias("low"), "k", F.coalesce("__left", "left").alias("left"), F.coalesce("__high", "high").alias("high"), (done | F.col("__few") | (F.col("__low") == F.col("__high"))).alias("ready")), "windows")
        drop_staged(before)
    found = _passed(rows, anchors, state.select("anchor_id", "win", "top", "low", "k").withColumn("shift", F.lit(0).cast("long")), blocks, same, _gather, "anchor_id long, win long, score long, id long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "win").orderBy(F.desc("score"), "id"))
    first = found.withColumn("rank", place).join(state.select("anchor_id", "win", "k"), ["anchor_id", "win"]).filter("rank <= k")
    out = stage(first.select("anchor_id", "win", "id", "score", "rank"), "selected")
    drop_staged(state)
    return out


def _hundredths(score: Column, share: int) -> Column:
    """floor(share * score / 100) of integers."""
    x = score * share
    return ((x - F.pmod(x, F.lit(100))) / 100).cast("long")


def hard_negatives(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for anchors (ids
    divisible by `every`) and their first `positives` rows of the same label, the first `negatives`
    rows of other labels that score `low` to `high` hundredths of the positive."""
    ready = stage(integer_rows(rows, vec_id, label, vector, scale), "vectors")
    square = F.aggregate("q", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x).cast("decimal(38,0)"))
    size = ready.agg(F.count("*").alias("n"), F.max(square).alias("most")).first()
    most = min(int(size["most"] or 0), (1 << 62) - 1)  # no score is beyond the largest square
    blocks = max(1, -(-size["n"] // BLOCK_ROWS), min(LEAST_BLOCKS, -(-size["n"] // 256)))
    anchors = stage(ready.filter(F.pmod("id", F.lit(every)) == 0), "anchors")
    all_scores = anchors.select(F.col("id").alias("anchor_id"), F.lit(0).cast("long").alias("win"), F.lit(most).cast("long").alias("top"), F.lit(-most).cast("long").alias("low"), F.lit(positives).cast("long").alias("k"))
    found = select_top(ready, anchors, all_scores, blocks, True)
    near = found.select("anchor_id", F.col("id").alias("win"), _hundredths(F.col("score"), high).alias("top"), (-_hundredths(-F.col("score"), low)).alias("low"), F.lit(negatives).cast("long").alias("k")).filter("low <= top")
    hard = select_top(ready, anchors, near, blocks, False)
    drop_staged(ready, anchors)
    positive = found.select("anchor_id", F.col("id").alias("win"), F.col("score").alias("positive_score"))
    return hard.join(positive, ["anchor_id", "win"]).select("anchor_id", F.col("win").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
