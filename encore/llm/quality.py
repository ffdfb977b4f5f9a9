"""Quality rules: hashed n-gram log-likelihood ratio, with plain text statistics before it.

Words are maximal runs without ASCII white space. Word unigrams and bigrams are hashed to a fixed
number of cells; one multinomial is counted over the trusted texts (at most `max_trusted` labelled
documents, the first by a seeded hash of their id), one over all documents of the corpus. A
document's score is the mean over its n-grams of log p_trusted - log p_raw, and it is kept if the
score reaches `threshold` and the base rules pass. The same text always gets the same verdict.

Nulls and empty texts have no word, fail the base rules and are not kept. Without any trusted text
every score is 0. Labels with a null id or grade count for nothing; an id labelled both ways is not
trusted. Repeated rows are counted and judged each."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import per_value, slices, sum_slices

CELLS = 1 << 16
MAX_TRUSTED = 20_000
THRESHOLD = -0.1
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_CONT = bytes(range(0x80, 0xC0))


def ngram_cells(words: list[bytes]) -> np.ndarray:
    """The cells of a text's unigrams and bigrams."""
    one = np.fromiter(map(crc32, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return (np.concatenate([one ^ (one >> np.uint64(16)), two]) & np.uint64(CELLS - 1)).astype(np.int64)


def base_counts(text: bytes | None) -> dict:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or b""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(distinct := set(windows)) < len(windows):
        often = {w for w, k in Counter(windows).items() if k > 1} if distinct else set()
        end = 0
        for i, w in enumerate(windows):
            if w in often:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return {
        "n_words": n,
        "word_chars": len(text.translate(None, _SPACE + _CONT)),
        "n_symbols": len(text) - len(text.translate(None, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat,
        "base_failed": n < 50 or 100 * repeat > 50 * n,
    }


def trusted_ids(labels: DataFrame, max_trusted: int, doc_id: str = "doc_id", grade: str = "quality") -> DataFrame:
    """At most `max_trusted` ids that every label calls good, the same ones each time."""
    good = labels.filter(F.col(doc_id).isNotNull() & F.col(grade).isNotNull()).groupBy(doc_id).agg(F.min(grade).alias("g")).filter("g >= 1")
    return good.select(doc_id).orderBy(F.xxhash64(doc_id), doc_id).limit(max_trusted)


def log_ratio(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """log p_trusted - log p_raw of every cell. One pass over the corpus; counts of a task are
    added up before they leave it, so what is shuffled is a vector for each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            cells: tuple[list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
            for body, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body and (words := body.split()):
                    cells[not good].append(ngram_cells(words))
            good, rest = (np.bincount(np.concatenate(x), minlength=CELLS) for x in cells)
            total += np.concatenate([good, good + rest])
        yield slices(total)

    trusted = trusted_ids(labels, max_trusted, doc_id).select(F.col(doc_id).alias("__id"), F.lit(True).alias("__good"))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("binary").alias("__t")).join(F.broadcast(trusted), "__id", "left").select("__t", "__good")
    both = sum_slices(rows.mapInArrow(count, "slice int, cells binary"), "int64")
    if not len(both) or not both[:CELLS].sum():
        return np.zeros(CELLS)
    good, raw = both[:CELLS] + 0.5, both[CELLS:] + 0.5
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def judge_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "quality_check", max_trusted: int = MAX_TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with a struct column `out`: the base counts, base_failed, score, kept."""
    ratio = log_ratio(docs, labels, text, doc_id, max_trusted)

    def start():
        def one(body: bytes | None) -> dict:
            found = base_counts(body)
            cells = ngram_cells(body.split()) if found["n_words"] else []
            score = float(ratio[cells].mean()) if len(cells) else 0.0
            return found | {"score": score, "kept": not found["base_failed"] and score >= threshold}

        return one

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = pa.struct([*((c, pa.int64()) for c in names), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])
    returns = f"struct<{', '.join(f'{c}: bigint' for c in names)}, base_failed: boolean, score: double, kept: boolean>"
    return docs.withColumn(out, per_value(start, returns, kind)(F.col(text)))
