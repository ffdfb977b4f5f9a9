"""Queries over whole tables: the SQL of those over a part of the ids, without its filter."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pytest

from encore.plans import catalog, oracles


@pytest.mark.parametrize("name", ["library_anti_join", "vector_zscore"])
def test_the_other_name_gives_the_same(spark, sf_dir, same_rows, name):
    same_rows(catalog.queries()[f"{name}_all"](spark, sf_dir), oracles.oracle_sql()[name])


def test_no_sql_reads_a_part_of_the_ids():
    for sql in oracles.oracle_sql().values():
        assert not re.search(r"(?:WHERE|AND) \w*_?(?:id|partkey) < \d|WHERE p_partkey % 7", sql)


def test_fuzzy_match_against_a_loop(spark, sf_dir, duck):
    plain = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", re.sub(r"\([^)]*\)", "", s.lower()))).strip()
    library = duck.execute("SELECT DISTINCT p_brand, p_name FROM part JOIN lineitem ON l_partkey = p_partkey").fetchall()
    due = set()
    for key, name, brand in duck.execute("SELECT p_partkey, p_name, p_brand FROM part").fetchall():
        title, bracket = plain(name + ("" if key % 2 == 0 else " x")), "live" if key % 2 == 0 else None
        for other, song in library:
            nt = plain(song)
            if other == brand and (title == nt or bracket and (bracket in nt or len(nt) > 3 and nt in bracket) or SequenceMatcher(None, title, nt).ratio() >= 0.85):
                due.add(key)
    assert {r["ext_id"] for r in catalog.fuzzy_match_all(spark, sf_dir).collect()} == due
    assert any(k % 7 for k in due) and {r["ext_id"] for r in catalog.fuzzy_match(spark, sf_dir).collect()} == due
