"""Base counts against regular expressions, scores against a plain count."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from encore.llm.quality import base_counts, judge_quality, ngram_cells

TEXTS = [None, "", " ", "\n\n", "a", "a b c a b c", "x\nx\n\n x\nx", "#*$%&|<> é b", "\x0b\x0c\r\t", "a a a a a a", "one two three\none two three\none two three", " wide"]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeat = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(repeat), "base_failed": len(words) < 50 or 100 * len(repeat) > 50 * len(words)}


def test_base_counts():
    rng = random.Random(4)
    more = ["".join(rng.choice(["a", "b", "c ", " ", "\n", "é", "#", "<"]) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    for t in TEXTS + more:
        assert base_counts(None if t is None else t.encode()) == plain_counts(t), t


def corpus(rng):
    good, bad = [f"good{k}" for k in range(40)], [f"junk{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad) for _ in range(80))) for k in range(40)]
    return [*rows, (90, None), (91, ""), (92, "short"), (None, "no id " * 30), (93, "same words " * 40), (1, rows[1][1])]


def test_scores_and_verdicts(spark):
    docs = corpus(random.Random(1))
    labels = [(k, k % 2) for k in range(0, 40, 3)] + [(1, 1), (5, 1), (5, 0), (None, 1), (7, None)]
    frame = spark.createDataFrame([(*d, 5, "s") for d in docs], "doc_id long, text string, n_words int, score string")
    got = judge_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    trusted = {i for i, _ in labels if i is not None and i != 7 and all(q == 1 for j, q in labels if j == i)}
    good, raw = Counter(), Counter()
    for i, t in docs:
        cells = ngram_cells((t or "").encode().split()).tolist() if t else []
        raw.update(cells)
        good.update(cells if i in trusted else [])
    size = 1 << 16
    for r in got:
        check = r["quality_check"]
        want = plain_counts(r["text"])
        assert {k: check[k] for k in want} == want
        cells = ngram_cells(r["text"].encode().split()).tolist() if want["n_words"] else []
        ratio = [math.log((good[c] + 0.5) / (sum(good.values()) + size / 2)) - math.log((raw[c] + 0.5) / (sum(raw.values()) + size / 2)) for c in cells]
        assert check["score"] == pytest.approx(sum(ratio) / len(ratio) if ratio else 0.0)
        assert check["kept"] == (not want["base_failed"] and check["score"] >= -0.1)
    by = {r["doc_id"]: r["quality_check"]["score"] for r in got}
    assert min(by[k] for k in range(1, 40, 2)) > max(by[k] for k in range(0, 40, 2))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w " * 60 + " ".join(map(str, range(99))))], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert judge_quality(docs, labels).first()["quality_check"]["score"] == 0
    assert judge_quality(docs.limit(0), labels).count() == 0
