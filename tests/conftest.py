"""One session for all tests, and the folders of test tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from encore.session import session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value):
    """A value as both engines show it: floats to 6 digits, lists and times as text."""
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if hasattr(value, "tolist"):
        value = value.tolist()
    return str([plain(x) for x in value]) if isinstance(value, (list, tuple)) else str(value)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Asserts that a DataFrame and a query of DuckDB have the same columns and rows."""

    def check(df, sql: str, con=None) -> None:
        got = (con or duck).execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        ours = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
        theirs = sorted(repr(tuple(map(plain, r))) for r in got.fetchall())
        assert ours == theirs

    return check
