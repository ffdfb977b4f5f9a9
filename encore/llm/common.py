"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, as SQL `translate` takes it.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def own_name(of: str) -> str:
    """A column name that no table has, for what is dropped again."""
    return f"__{of}_{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array, rows: int = 256) -> Iterator[bytes | None]:
    """The column's values as UTF-8 bytes; None stays None. Only some rows at a time are copied."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).cast(pa.large_binary()).to_pylist()


def give_back() -> None:
    """Hand memory that a task has freed to the system. Python workers outlive their tasks; without
    this what one stage needed is held while the next ones run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def released(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives memory back when it ends."""

    def run(batches: Iterator) -> Iterator:
        yield from fn(batches)
        give_back()

    return run


def per_value(fn: Callable[[], Callable], returns: str, kind: pa.DataType, release: bool = False):
    """A column function from one text column to a struct.

    `fn()` runs once in each task and gives a function from bytes to a tuple or dict of fields. It
    is marked nondeterministic so that the planner evaluates it once, not in filter and projection."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = fn()
        for batch in batches:
            yield pa.array([one(x) for x in utf8(batch)], kind)
        if release:
            give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns).asNondeterministic()


def sum_slices(parts: DataFrame, dtype: str, either: bool = False) -> np.ndarray:
    """Sum (or OR) equal-length vectors that tasks emit as rows (slice int, cells binary).

    Each slice meets in one task, which keeps a single running slice; the result has the fixed
    length the caller chose, whatever the size of the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(cells, dtype)
                if k not in total:
                    total[k] = own.copy()
                elif either:
                    total[k] |= own
                else:
                    total[k] += own
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(total), pa.int32()), "cells": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    dealt = parts.repartition(16, "slice").mapInArrow(add, "slice int, cells binary")
    found = {r["slice"]: np.frombuffer(r["cells"], dtype) for r in dealt.collect()}
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(0, dtype)


def slices(vector: np.ndarray, count: int = 64) -> pa.RecordBatch:
    """A vector cut into `count` rows for `sum_slices`."""
    return pa.RecordBatch.from_pydict({"slice": pa.array(range(count), pa.int32()), "cells": pa.array([x.tobytes() for x in np.split(vector, count)], pa.binary())})
