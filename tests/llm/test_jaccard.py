"""The join against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from encore.llm import jaccard
from encore.llm.jaccard import keep_one, link_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    top = list(range(len(docs)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((repr(i), len(sets[k]), repr(least.get(root(k)) if sets[k] else i)) for k, (i, _) in enumerate(docs))


def near(rng, words, changes):
    w = list(words)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


def cases(seed):
    rng = random.Random(seed)
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 5, 7, 9, 30, 60, 120]))]
        for _ in range(rng.randint(1, 8)):
            docs.append(" ".join(near(rng, base, rng.choice([0, 0, 1, 1, 2, 3]))))
        chain = base
        for _ in range(rng.randint(0, 6)):  # each links with the next, the ends do not
            chain = near(rng, chain, 1)
            docs.append(" ".join(chain))
    common = "all documents share this one long passage of many words here"
    docs += [f"{common} {' '.join(f'z{rng.randrange(10**6)}' for _ in range(rng.randint(0, 30)))}" for _ in range(20)]
    base = [f"v{k}" for k in range(80)]
    docs += [" ".join(near(rng, base, rng.randint(1, 4))) for _ in range(60)]  # many pairs, some of them linked
    rng.shuffle(docs)
    rows = [(1000 + 7 * k, t) for k, t in enumerate(docs)]
    return rows + [(1, None), (2, ""), (3, " \n\t"), (4, "One  two"), (5, "one two"), (6, "one two three"), (None, "one two"), (7, "a b c d e"), (8, "A b c\nd e"), (9, "é É"), (10, "é é"), (1000, docs[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = cases(seed)
    frame = spark.createDataFrame([(*d, 0, 1, "x") for d in docs], "doc_id long, text string, a int, n int, tok string").repartition(3)
    got = link_components(frame)
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got.collect()) == brute(docs)


def test_pairs_with_the_least_overlap(spark):
    """Sets of n and m that share just enough, or one too few."""
    docs, at = [], 0
    for n in (5, 9, 10, 18, 27, 45, 90):
        for cut in range(4):
            base = [f"s{n}x{cut}y{k}" for k in range(n + 4)]
            for end in range(0, n // 4 + 2):
                docs.append((at, " ".join(base[: len(base) - end])))
                at += 1
    got = link_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got.collect()) == brute(docs)


def test_one_of_each_group_stays(spark):
    docs = cases(1)
    frame = spark.createDataFrame([(*d, "u") for d in docs], "doc_id long, text string, component_id string")
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(i for i, _, c in brute(docs) if i == c or i == "None")


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert link_components(frame).count() == 0
    assert keep_one(frame).count() == 0


def test_longer_prefixes_where_lists_are_full():
    tokens = np.sort(np.random.default_rng(1).integers(0, 2**64, 100, np.uint64))
    usual = jaccard.prefix(tokens, np.zeros(jaccard.CELLS, np.uint8))
    full = jaccard.prefix(tokens, np.full(jaccard.CELLS, 9, np.uint8))
    for own, least in (usual, full):
        assert len(own) == 100 - 80 + least
    assert full[1] >= usual[1] >= 1


def test_sized_keeps_what_fits_another_of_its_list():
    rng = random.Random(4)
    rows = sorted((rng.randrange(40), rng.choice([0, 0, 0, 1]), k, k, rng.choice([4, 5, 9, 10, 11, 50, 300, 370, 380]) << 8 | 1) for k in range(150))
    fits = lambda n, m: min(n, m) * 100 >= max(n, m) * 80
    want = [r for r in rows if r[1] or any(s[:2] == r[:2] and s != r and fits(r[4] >> 8, s[4] >> 8) for s in rows)]
    assert jaccard._sized(np.array(rows, np.int64)).tolist() == [list(r) for r in want]
    assert 0 < len(want) < len(rows)
    assert not len(jaccard._sized(np.array([[1, 0, 2, 2, 9 << 8]], np.int64)))
