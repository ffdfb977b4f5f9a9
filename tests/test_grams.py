"""Text joins against loops over all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from encore.operators import matching
from encore.operators.grams import contained, may_be_similar


def test_contained(spark):
    rng = random.Random(1)
    word = lambda m: "".join(rng.choice("abé ") for _ in range(rng.randint(0, m)))
    short = [(k, rng.choice("xy"), rng.choice([word(5), None])) for k in range(80)]
    long = [(k, rng.choice("xy"), rng.choice([word(12), None])) for k in range(80)]
    due = {(i, j) for i, g, s in short for j, h, t in long if g == h and s and t and s in t}
    got = contained(spark.createDataFrame(short, "sid long, b string, s string"), spark.createDataFrame(long, "lid long, b string, l string"), ["b"])
    rows = [(r["sid"], r["lid"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == due and due


@pytest.mark.parametrize("least", [0.82, 0.85, 0.95])
def test_nothing_similar_is_missed(spark, least):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeée ") for _ in range(rng.randint(1, 30))) for _ in range(60)]

    def bent(s):
        s = list(s)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
        return "".join(s)

    one, two = [*base, "aaaaaa", "abababab"], [bent(s) for s in base for _ in range(2)] + ["aaaaaaa", "babababa", ""]
    due = {(x, y) for x in one for y in two if x != y and SequenceMatcher(None, x, y).ratio() >= least}
    got = {(r["x"], r["y"]) for r in may_be_similar(spark.createDataFrame([(x,) for x in one], "x string"), spark.createDataFrame([(y,) for y in two], "y string"), least).collect()}
    assert due <= got and len(due) >= 15 and len(got) < len(one) * len(two) / 2


def test_matches_by_every_rule(spark):
    library = spark.createDataFrame([(1, "Good Night (좋은 밤)", "Nell", 3), (2, "Red Ocean", "Nell", 3), (3, "Other", "IU", 3), (4, None, "Nell", 1), (5, "Song (very long bracket)", "Nell", 2)], "song_id long, title string, artist string, plays long")
    asked = {1: ("good night", "nell"), 2: ("좋은 밤", "넬"), 3: ("x (Red Ocean)", "Nell - Topic"), 4: ("Red Oceans", "NELL"), 5: ("long bracket", "Nell"), 6: ("Other", "Nell"), 7: ("Other", "아이유"), 8: (None, "Nell"), 9: ("Red", "Nell"), 10: ("zz (the Red Ocean song)", "Nell"), 11: ("Red Ocean", None)}
    ext = spark.createDataFrame([(k, *v) for k, v in asked.items()], "ext_id long, title string, artist string")
    found = lambda least: {r["ext_id"] for r in matching.matches(ext, matching.library_index(library), least).collect()}
    assert found(None) == {1, 2, 3, 5, 7, 10} and found(0.85) == {1, 2, 3, 4, 5, 7, 10}
