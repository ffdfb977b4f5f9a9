"""Elapsed time, week keys and reproducible uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def days_floor(a: Column, b: Column) -> Column:
    """Whole days from a to b, by elapsed time and not by calendar."""
    return F.floor((F.unix_timestamp(b) - F.unix_timestamp(a)) / DAY).cast("long")


def days(a: Column, b: Column) -> Column:
    """Days from a to b with their fraction, seconds cut."""
    return (F.unix_timestamp(b) - F.unix_timestamp(a)) / F.lit(float(DAY))


def week_key(ts: Column) -> Column:
    """ISO week + 52 x ISO year; week 53 falls together with the next year's week 1."""
    return (F.weekofyear(ts) + F.extract(F.lit("YEAROFWEEK"), ts) * 52).cast("long")


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from a seed and a key, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
