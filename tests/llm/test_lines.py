"""Line dedup against a dictionary of all lines, by either way of probing."""

from __future__ import annotations

import random

import numpy as np
import pytest

from encore.llm import lines
from encore.llm.lines import NO_ID, PerfectHash, dedup_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\r\x0b\x0c").translate(LOWER)


def brute(docs):
    held = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(NO_ID if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        own = NO_ID if i is None else i
        left = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == own]
        out.append((repr(i), len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


def cases():
    rng = random.Random(5)
    pool = [f"shared line {k} of the pool" for k in range(30)] + ["  Shared LINE 1 of the pool\t", "short", "", "éééééééééé", "ééééééééé", " shared line 2 of the pool"]
    docs = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {rng.random()}" for _ in range(rng.randint(0, 12)))) for k in range(60)]
    return docs + [(100, None), (101, ""), (102, "\n\n"), (None, "shared line 3 of the pool"), (None, "null line, twice"), (None, "null line, twice"), (7, "shared line 4 of the pool\nshared line 4 of the pool"), (200, "only here, twice\nonly here, twice"), (-3, "shared line 5 of the pool\r\nlong" + "x" * 200_000)]


@pytest.mark.parametrize("shard_keys,most", [(200_000, 96 << 20), (4, 96 << 20), (4, -1), (200_000, -1)])
def test_against_brute_force(spark, shard_keys, most):
    docs = cases()
    frame = spark.createDataFrame([(*d, 1, 2, "x", 3, 4, 5, 6) for d in docs], "doc_id long, text string, a int, shard int, owner string, __gone int, __d int, h int, salt int").repartition(3)
    got = dedup_lines(frame, shard_keys=shard_keys, max_broadcast=most)
    assert sorted(got.columns) == sorted([*frame.columns, "lines"])
    assert sorted((repr(r["doc_id"]), r["lines"]["n_lines"], r["lines"]["n_dropped"], r["lines"]["kept"]) for r in got.collect()) == brute(docs)


def test_a_hot_line_many_null_ids_and_small_probes(spark, monkeypatch):
    """By shard: a line that a third of all documents hold, rows without an id that share nothing else,
    probes in several parts, and a column of the result's name, which is replaced."""
    monkeypatch.setattr("encore.llm.lines._probe_by_shard.__defaults__", (20,))
    docs = [(k if k % 5 else None, "\n".join([f"own line number {k}", *(["a hot line of many"] if k % 3 == 0 else []), f"line of a pair {k // 2}"])) for k in range(300)]
    frame = spark.createDataFrame([(*d, "mine") for d in docs], "doc_id long, text string, lines string").repartition(4)
    got = dedup_lines(frame, shard_keys=30, max_broadcast=-1)
    assert got.columns == frame.columns
    assert sorted((repr(r["doc_id"]), r["lines"]["n_lines"], r["lines"]["n_dropped"], r["lines"]["kept"]) for r in got.collect()) == brute(docs)


@pytest.mark.parametrize("most", [96 << 20, -1])
def test_empty_table_and_nothing_repeated(spark, most):
    frame = spark.createDataFrame([(1, "a single long line"), (2, "another long line")], "doc_id long, text string")
    assert dedup_lines(frame.limit(0), max_broadcast=most).count() == 0
    assert [r["lines"]["n_dropped"] for r in dedup_lines(frame, max_broadcast=most).collect()] == [0, 0]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, n))
    made = PerfectHash.build(a, b)
    assert sorted(made.index(a, b).tolist()) == list(range(n))
    again = PerfectHash.unpack(*made.pack())
    assert (again.index(a, b) == made.index(a, b)).all()
    other = again.index(a + 1, b)
    assert ((other >= -1) & (other < max(n, 1))).all()


def test_probing_holds_few_documents_at_a_time(spark, monkeypatch):
    """A task's Python values are those of some documents, and their memory goes back at its end."""
    import tracemalloc

    import pyarrow as pa

    back = []
    monkeypatch.setattr(lines, "give_back", lambda: back.append(1), raising=False)
    probe = lines._probe_all([], 1, 10).func
    texts = ["\n".join(f"document {k} has line {j}" for j in range(40)) for k in range(6000)]
    ids, bodies = pa.array(range(6000), pa.int64()), pa.array(texts)
    tracemalloc.start()
    found = [x for x in probe(iter([(ids, bodies)]))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in found] == [6000] and found[0].field("kept").to_pylist() == texts
    assert most < 16 << 20 and back == [1]
