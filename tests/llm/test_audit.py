"""Filter audit: a plain loop over documents and orders, and the odd rows."""

from __future__ import annotations

import random
import re
from itertools import permutations

from encore.llm.audit import filter_audit


def brute(docs, labels):
    """{(part, order, step): figures}."""
    good, bad = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((lang or "", {f for f in fails if fails[f]}, i in good, i in bad))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                out[part, order, step] = (len(kept), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                left = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


def test_against_a_loop(spark):
    rng = random.Random(5)
    made = [" ".join(rng.choice(["the", "Of", "x|y", "wörter", "#1", f"w{rng.randrange(400)}", f"v{rng.randrange(900)}"][: rng.randint(2, 7)]) for _ in range(rng.choice([3, 150, 199, 200, 260]))) for _ in range(40)]
    texts = [*made, None, "", "A\x0bB", "  \t", "word " * 300, "é" * 5000, "long " * 20000]
    docs = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)] + [(100 + k, rng.choice(texts), "en") for k in range(30)] + [(3, texts[3], "en"), (3, texts[5], "de"), (None, texts[3], "en"), (None, "alone", None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(i, t, p, 1, "h") for i, t, p in docs], "doc_id long, text string, lang string, mask int, part string")
    lf = spark.createDataFrame([(*x, True) for x in labels], "doc_id long, quality int, toxic int, good boolean")
    assert found(filter_audit(df, lf)) == brute(docs, labels)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    lf = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(df, lf).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], df.schema)
    assert filter_audit(one, lf).count() == 600


def test_copies_meet_in_no_task(spark):
    """A text that most rows share: each row is joined by text and id."""
    df = spark.createDataFrame([(k, "same" if k % 3 else f"own {k}", "en") for k in range(600)], "doc_id long, text string, lang string")
    lf = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = found(filter_audit(df, lf))
    assert got["en", "EABCD", 1] == (201, 399, 0, 0, 0, 0, got["en", "EABCD", 1][-1])
