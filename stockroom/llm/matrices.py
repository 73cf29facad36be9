"""Sums of matrices over all rows: every task gives one partial sum for each vector length, two grouped steps add them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Partial sums that one grouped call adds at first; the second step adds what those calls give.
FAN_IN = 256


def _added(parts: pa.Table) -> pa.Table:
    """The sum of one group's matrices, in the order of the parts they come from, so that it is the same in every run."""
    parts = parts.sort_by("part")
    total = sum(np.frombuffer(b, "<f8") for b in parts.column("sums").to_pylist())
    return pa.table({"dim": parts.column("dim").slice(0, 1), "part": parts.column("part").slice(0, 1),
                     "sums": pa.array([total.tobytes()], pa.binary())})


def matrix_sums(rows: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """{vector length: summed float64 matrix}; ``each`` turns a task's batches into its partial sums.

    The driver gets one matrix for each vector length: its size depends on the length, not on the rows.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for dim, sums in each(batches).items():
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([part], pa.int32()),
                                   pa.array([sums.astype("<f8").tobytes()], pa.binary())], names=["dim", "part", "sums"])

    kind = "dim int, part int, sums binary"
    some = rows.mapInArrow(partial, kind).withColumn("group", F.floor(F.col("part") / FAN_IN))
    some = some.groupBy("dim", "group").applyInArrow(_added, kind)
    found = some.groupBy("dim").applyInArrow(_added, kind).collect()
    return {r["dim"]: np.frombuffer(r["sums"], "<f8") for r in found}


def stacked(column: pa.Array, dtype: type = np.float64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the lists of each length in a list column without nulls; empty lists are left out."""
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = column.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, flat[ends[at][:, None] + np.arange(dim)].astype(dtype)
