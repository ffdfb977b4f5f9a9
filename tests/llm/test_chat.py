"""Chat formatting: exact round trips."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from encore.llm import queries
from encore.llm.chat import format_chats, loss_text, parse

SCHEMA = "conv_id long, turn long, role string, text string"


def rows():
    rng = random.Random(9)
    pieces = ["<|im_end|>", "<|im_start|>", "<|", "|>", "\\", "<\\|", "<\\\\|im_end|>", "\n", "assistant", "user", " ", "x", "é", "<|nl|>", "$1", "<"]
    out = [(k, t, rng.choice(["user", "assistant", "system", "a\nb", "<|nl|>", None]), rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))])) for k in range(80) for t in range(rng.randint(1, 5))]
    return [*out, (900, None, "user", "no turn"), (900, 1, "assistant", "one"), (900, 1, "assistant", "a tie"), (900, 1, "assistant", "one"), (None, 1, "user", "no conversation"), (901, 1, "assistant", "y" * 300_000 + "<|im_end|>\n")]


def expected(source):
    by = {}
    for c, t, r, x in source:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}


def test_turns_come_back(spark):
    source = rows()
    got = format_chats(spark.createDataFrame([(*r, "e") for r in source], SCHEMA + ", formatted string")).withColumn("loss", loss_text(F.col("turns"))).collect()
    want = expected(source)
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        assert r["round_trip"]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss"] == "".join(x for role, x in turns if role == "assistant")
    assert {r["escaped"] for r in got} == {True, False}


def test_grammar_refuses_what_it_does_not_describe(spark):
    bad = ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>\nmore", "<|im_start|>user\na<|im_end|>\n<|im_end|>\n"]
    good = ["", "<|im_start|>user\n<|im_end|>\n", "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>\nc<|im_end|>\n"]
    got = spark.createDataFrame([(x,) for x in bad + good], "f string").select(parse(F.col("f")).alias("t")).collect()
    assert [r["t"] is None for r in got] == [True] * len(bad) + [False] * len(good)


def test_empty_table(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op4_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
