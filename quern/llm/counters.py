"""Arrays of counters of a fixed size, filled by tasks over all rows and summed by parts in two steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = "part int, grp int, counts binary"
#: Tasks are dealt into so many groups for the first step of the sum.
GROUPS = 256


def emit(counts: np.ndarray, parts: int, task: int) -> Iterator[pa.RecordBatch]:
    """The counters of a task (uint32) as one compressed row for each part; zeros alone give no row."""
    for i, x in enumerate(counts.reshape(parts, -1)):
        if x.any():
            yield _row(i, task % GROUPS, x.astype(np.uint64))


def _row(part: int, grp: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([grp], pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1)])], names=["part", "grp", "counts"])


def summed(rows: DataFrame, finish: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """One row per part: its counters (uint64) over all tasks, as finish() makes them. A task holds one part and one row at a time."""

    def step(last: bool):
        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for x in b.column(b.schema.get_field_index("counts")).to_pylist():
                    one = np.frombuffer(zstandard.decompress(x), np.uint64)
                    total = one.copy() if total is None else total + one
            yield _row(key[0].as_py(), 0, finish(total) if last else total)

        return add

    return rows.groupBy("part", "grp").applyInArrow(step(False), SCHEMA).groupBy("part").applyInArrow(step(True), SCHEMA)


def collected(rows: DataFrame, finish: Callable[[np.ndarray], np.ndarray], parts: int, size: int, dtype: type) -> np.ndarray:
    """All parts of a sum at the driver, (parts, size); the size is a parameter, not the data's."""
    out = np.zeros((parts, size), dtype)
    for r in summed(rows, finish).select("part", "counts").collect():
        out[r["part"]] = np.frombuffer(zstandard.decompress(bytes(r["counts"])), dtype)
    return out
