"""Sums of fixed-size count vectors over a whole table, added up in streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "block int, counts binary"
BLOCKS = 16


def as_rows(total: np.ndarray) -> pa.RecordBatch:
    """A task's vector as BLOCKS rows."""
    parts = [x.astype("<i8").tobytes() for x in total.reshape(BLOCKS, -1)]
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = np.frombuffer(counts, "<i8")
            total[block] = total[block] + new if block in total else new
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def gathered(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' vectors; BLOCKS rows of ``size`` numbers together reach the driver."""
    total = np.zeros((BLOCKS, size // BLOCKS), np.int64)
    for row in rows.repartition(BLOCKS, "block").mapInArrow(_add, SCHEMA).collect():
        total[row.block] = np.frombuffer(row.counts, "<i8")
    return total.ravel()
