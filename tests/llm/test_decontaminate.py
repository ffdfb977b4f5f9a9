"""Wu-Manber search against looking for every window at every position."""

from __future__ import annotations

import random
import re

import pytest

from encore.llm.decontaminate import decontaminate, find_hits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, body in items:
        p = words(body)
        m = min(10, len(p))
        for s in range(len(p) - m + 1) if p else ():
            for at in range(len(w) - m + 1):
                if w[at : at + m] == p[s : s + m]:
                    hit.update(range(at, at + m))
                    ids |= {str(item)} if item is not None else set()
    return len(w), sorted(hit), sorted(ids)


def cases():
    rng = random.Random(3)
    vocabulary = ["a", "b", "Ünï", "c9", "x"]

    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))

    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 14]))) for k in range(8)] + [(8, None), (9, ""), (None, "q r s t"), (10, "A-b"), (100, "q R s t")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(40)] + [(40, None), (41, ""), (42, "q r s t"), (None, "q r s t"), (43, "..."), (42, "q r s t"), (44, f"{text(10)} {items[3][1]} zzz")]
    docs += [(50 + k, (items[k][1] or "") + " word" * 3000) for k in range(3)]
    return docs, items


@pytest.mark.parametrize("most", [200_000, 3])
def test_against_brute_force(spark, most):
    docs, items = cases()
    frame = spark.createDataFrame([(*d, 1, "x", 2, "y") for d in docs], "doc_id long, text string, n_words int, window string, hits_next int, items string")
    got = find_hits(frame, spark.createDataFrame(items, "item_id long, text string"), max_patterns=most)
    assert got.columns == [*frame.columns, "hits"]
    ours = sorted((repr(r["doc_id"]), r["text"] or "", r["text"] is None, r["hits"]["n_words"], r["hits"]["hit"], r["hits"]["items"]) for r in got.collect())
    assert ours == sorted((repr(i), t or "", t is None, *brute(t, items)) for i, t in docs)


def test_a_column_of_the_results_name_is_replaced(spark):
    frame = spark.createDataFrame([(1, "a b", "mine", 7)], "doc_id long, text string, hits string, hits_next int")
    got = find_hits(frame, spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id long, text string"), max_patterns=1).first()
    assert (got["hits"]["items"], got["hits"]["hit"], got["hits_next"]) == (["1", "2"], [0, 1], 7)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).count() == 1
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, "a")], none.schema)).count() == 0


def test_hit_documents_go_and_clean_ones_stay(spark):
    docs, items = cases()
    kept = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(i) for i, t in docs if not brute(t, items)[1])
