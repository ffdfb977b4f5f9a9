"""Every query of the play-log engine against its SQL; those without SQL give rows of one schema."""

from __future__ import annotations

import pytest

from encore.plans import catalog, oracles

QUERIES, SQL = catalog.queries(), oracles.oracle_sql()
#: Need more rows than the smallest tables hold.
LARGER = {"decline_signals", "weibull_forecast", "revival_auc", "panel_gbt_oof"}


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    rows = found.collect()
    assert found.columns and (rows or name in LARGER)


def test_entry(spark):
    import __spark_entry__ as registered

    assert registered.entry(spark).count() > 0
    assert set(QUERIES) <= set(registered.queries())
    assert set(registered.oracle_sql()) <= set(registered.queries())
