"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and their character n-grams with word boundaries (`^idio`, `iot$`). The model
has one weight for each feature, shared by all ordered thresholds:
P(grade > k) = sigmoid(w . x - theta_k), theta_0 < theta_1 < ...; the output is the expected
severity, sum over k of P(grade > k).

It is fitted on at most `max_rows` labelled documents (the first by a seeded hash of their id), of
which copies and most near copies (equal least shingle) count once. From these, features that occur
in toxic documents at over 10 times the rate of clean ones are taken, at most `max_features`; their
weights are kept from falling below 0, as they were chosen to speak for toxicity. The labels only
say toxic or not, so toxic examples are graded mild (1) or severe (2) by how many of their words
carry such a feature, up to or above the median.

A null or empty text has no feature and gets the severity of a text without any. Labels with a null
id or label count for nothing; an id labelled twice takes the highest. Without labels of both kinds
every severity is 0. Repeated rows are scored one by one."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import own_name, per_value, released, utf8
from encore.staging import stage

MAX_ROWS = 12_000
MAX_FEATURES = 4_096
#: Features that a task counts before it passes the counts on.
MAX_COUNTED = 200_000
SIZES = (4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked} | {marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1)}


def words_of(text: bytes | None) -> list[str]:
    return _WORD.findall(text.decode().lower()) if text else []


@dataclass
class Model:
    """Weights of the features and the ordered thresholds."""

    features: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, score: float) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -40, 40)))


class FeatureCounter:
    """How many words of a text carry each feature; what a word carries is remembered."""

    def __init__(self, features: list[str], most: int = 100_000):
        self.at, self.most = {f: k for k, f in enumerate(features)}, most
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, words: list[str]) -> tuple[Counter, int]:
        """Counts by feature, and the number of words with any."""
        counts: Counter = Counter()
        marked = 0
        for w in words:
            own = self.known.get(w)
            if own is None:
                own = tuple(sorted({self.at[f] for f in word_features(w) if f in self.at}))
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[w] = own
            if own:
                marked += 1
                counts.update(own)
        return counts, marked


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, grade: str, max_rows: int) -> DataFrame:
    """(id, y, t) of at most `max_rows` labelled ids, the same ones each time."""
    ids = labels.filter(F.col(doc_id).isNotNull() & F.col(grade).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(grade).alias("y"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for body in utf8(batch.column("t")):
                w = body.lower().split() if body else []
                keys.append(min(map(crc32, map(b" ".join, zip(w, w[1:], w[2:], strict=False))), default=-crc32(body or b"")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["id", "y", "t", "key"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).join(F.broadcast(ids), "id")
    rows = rows.select("id", F.col("y").cast("int"), "t").mapInArrow(released(keyed), "id long, y int, t binary, key long")
    return rows.groupBy("key").agg(F.min(F.struct("id", "y", "t")).alias("r")).select("r.*")


def enriched_features(sample: DataFrame, max_features: int, ratio: float = 10.0, least: int = 6) -> list[str]:
    """The features that mark toxic documents, best first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        clean: Counter = Counter()

        def counted() -> pa.RecordBatch:
            names = list(toxic.keys() | clean.keys())
            out = pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "toxic": pa.array([toxic[x] for x in names], pa.int64()), "clean": pa.array([clean[x] for x in names], pa.int64())})
            toxic.clear(), clean.clear()
            return out

        for batch in batches:
            for y, body in zip(batch.column("y").to_pylist(), utf8(batch.column("t")), strict=True):
                own: set[str] = set()
                for w in set(words_of(body)):
                    own |= word_features(w)
                (toxic if y > 0 else clean).update(own)
                if len(toxic) + len(clean) > MAX_COUNTED:
                    yield counted()
        yield counted()

    sizes = sample.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    if not all(sizes):
        return []
    found = sample.mapInArrow(released(count), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = (F.col("toxic") / sizes[0]) / ((F.col("clean") + 0.5) / sizes[1])
    best = found.filter(F.col("toxic") >= least).withColumn("rate", rate).filter(F.col("rate") >= ratio)
    return [r["feature"] for r in best.orderBy(F.desc(F.col("toxic") * F.log("rate")), "feature").limit(max_features).select("feature").collect()]


def fit_ordinal(rows: list[dict[int, float]], grades: np.ndarray, features: list[str], steps: int = 300, l2: float = 0.5) -> Model:
    """Weights and thresholds by gradient steps (Adam) on the cumulative-link likelihood."""
    n, width, k = len(rows), len(features), int(grades.max())
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)]).astype(int)
    col = np.array([j for r in rows for j in r], int)
    val = np.array([v for r in rows for v in r.values()], float)
    share = np.array([(grades > j).mean() for j in range(k)]).clip(1e-3, 1 - 1e-3)
    first = np.log(1 / share - 1)
    param = np.concatenate([np.zeros(width), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(param), np.zeros_like(param)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    everyone = np.arange(n)
    for step in range(1, steps + 1):
        gaps = np.exp(param[width + 1 :])
        theta = param[width] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(at, param[col] * val, n)
        cdf = np.concatenate([np.zeros((n, 1)), sig(theta - score[:, None]), np.ones((n, 1))], 1)  # P(grade <= j - 1)
        slope = cdf * (1 - cdf)
        p = np.maximum(cdf[everyone, grades + 1] - cdf[everyone, grades], 1e-12)
        up, low = slope[everyone, grades + 1] / p, slope[everyone, grades] / p
        to_theta = np.zeros((n, k + 2))
        to_theta[everyone, grades + 1] -= up
        to_theta[everyone, grades] += low
        by_theta = to_theta[:, 1:-1].sum(0) / n
        g = np.empty_like(param)
        g[:width] = np.bincount(col, (up - low)[at] * val, width) / n + l2 * param[:width] / n
        g[width] = by_theta.sum()
        g[width + 1 :] = gaps * np.cumsum(by_theta[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        param -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        param[:width] = np.maximum(param[:width], 0)
    return Model(features, param[:width], param[width] + np.concatenate([[0], np.cumsum(np.exp(param[width + 1 :]))]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", grade: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """The model from a bounded labelled sample."""
    sample = stage(labelled_sample(docs, labels, text, doc_id, grade, max_rows), "toxic-sample")
    features = enriched_features(sample, max_features)
    none = Model([], np.zeros(0), np.array([40.0]))
    if not features:
        return none

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = FeatureCounter(features)
        for batch in batches:
            out = []
            for i, y, body in zip(batch.column("id").to_pylist(), batch.column("y").to_pylist(), utf8(batch.column("t")), strict=True):
                words = words_of(body)
                counts, marked = counter(words)
                out.append((i, int(y), marked, sorted(counts), [counts[k] for k in sorted(counts)]))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["id", "y", "marked", "at", "n"])

    rows = sorted(sample.mapInArrow(released(count), "id long, y int, marked long, at array<int>, n array<int>").collect(), key=lambda r: (r["id"], r["marked"], r["at"]))
    marked = np.array([r["marked"] for r in rows])
    toxic = np.array([r["y"] > 0 for r in rows])
    grades = toxic.astype(int) + (toxic & (marked > np.median(marked[toxic])))
    if grades.max() < 2:
        grades = toxic.astype(int)
    return fit_ordinal([dict(zip(r["at"], (value(n) for n in r["n"]), strict=True)) for r in rows], grades, features)


def value(count: int) -> float:
    """What a feature weighs by how often it occurs."""
    return 1 + float(np.log(count))


def score_toxicity(text: Column, model: Model) -> Column:
    """Struct: severity (expected grade), p_toxic (P(grade > 0)), grade (most likely one)."""

    def start():
        counter = FeatureCounter(model.features)
        weights = model.weights

        def one(body: bytes | None) -> dict:
            counts, _ = counter(words_of(body))
            p = model.exceed(sum(weights[k] * value(n) for k, n in sorted(counts.items())))
            each = -np.diff(np.concatenate([[1.0], p, [0.0]]))
            return {"severity": float(p.sum()), "p_toxic": float(p[0]), "grade": int(each.argmax())}

        return one

    kind = pa.struct([("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32())])
    return per_value(start, "struct<severity: double, p_toxic: double, grade: int>", kind, release=True)(text)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose P(grade > 0) is below the threshold, columns unchanged."""
    mark = own_name("toxicity")
    return docs.withColumn(mark, score_toxicity(F.col(text), model)).filter(F.col(f"{mark}.p_toxic") < threshold).drop(mark)
