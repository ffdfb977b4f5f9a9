"""Budgets against a recursive water-filling, and the prefixes of the leaves."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from encore.llm import queries
from encore.llm.mix import mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = rng.choice(["src0"] * 6 + ["src1", "src2", "src5", "src13", "blog", None, "src99999999999"])
        rows.append((k, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", "fr", None]), source, None))
    return rows + [(3, "again the same id", "en", "src0", 1), (None, "no id at all", "en", "src0", 1), (500, None, "en", "src0", 1), (501, "long " * 50_000, "es", "src1", 1)]


def domain_of(source):
    found = re.search(r"(\d+)$", source or "")
    return f"d{int(found[1]) % 4}" if found else "d0"


def fill(children, budget):
    """{name: budget} from {name: (cap, weight)}: the short ones get all they can use."""
    out, left = {}, dict(children)
    while True:
        weight = sum(w for _, w in left.values())
        full = [k for k, (cap, w) in left.items() if cap * weight <= w * budget]
        if not full:
            return out | {k: w * budget // weight for k, (_, w) in left.items()}
        for k in full:
            out[k] = left.pop(k)[0]
        budget -= sum(out[k] for k in full)


def brute(rows, share, weights, epochs, seed):
    leaves = defaultdict(list)
    for i, t, lang, source, _ in rows:
        if n := len(re.findall(r"[^\x20\x09-\x0D]+", t or "")):
            leaves[(domain_of(source), lang or "", source or "")].append((i, n))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}

    def down(head, budget):
        depth = len(head)
        if depth == 3:
            return {head: budget}
        names = {k[depth] for k in leaves if k[:depth] == head}
        level = ("domain", "lang", "source")[depth]
        caps = {x: (sum(s * epochs for k, s in size.items() if k[: depth + 1] == (*head, x)), weights.get(level, {}).get(x, 1)) for x in names}
        out = {}
        for x, b in fill(caps, budget).items():
            out |= down((*head, x), b)
        return out

    out = []
    for leaf, budget in down((), min(int(sum(size.values()) * share), sum(size.values()) * epochs)).items() if leaves else ():
        turn, rest = divmod(budget, size[leaf])
        place = lambda i: hashlib.md5(f"{seed}:{turn}:{'null' if i is None else i}".encode()).hexdigest()  # noqa: E731, B023
        for i, n in leaves[leaf]:
            upto = sum(m for j, m in leaves[leaf] if place(j) <= place(i))
            if copies := turn + (upto <= rest):
                out.append((repr(i), *leaf, n, copies))
    return sorted(out)


@pytest.mark.parametrize("share,epochs", [(0.5, 2), (1.0, 1), (1.7, 2), (5.0, 3), (0.0, 2)])
def test_against_recursion(spark, share, epochs):
    rows = docs(int(share * 10))
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", budget int, bucket string")
    got = mix(frame, queries.domain(), share, queries.MIX_WEIGHTS, epochs)
    assert sorted((repr(r["doc_id"]), r["domain"], r["lang"], r["source"], r["n_tokens"], r["copies"]) for r in got.collect()) == brute(rows, share, queries.MIX_WEIGHTS, epochs, 7)


def test_sql_gives_the_same(spark, same_rows):
    rows = docs(4)
    con = duckdb.connect()
    con.register("documents", pa.table({c.split()[0]: pa.array([r[k] for r in rows], pa.int64() if "long" in c else pa.string()) for k, c in enumerate(SCHEMA.split(", "))}))
    same_rows(mix(spark.createDataFrame(rows, SCHEMA), queries.domain(), weights=queries.MIX_WEIGHTS), "WITH " + queries.mix_sql("documents").lstrip(), con)


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA), queries.domain()).count() == 0
    assert mix(spark.createDataFrame([(1, None, "en", "s", 0)], SCHEMA), F.lit("d")).count() == 0
