"""A sieve of ids of a fixed size, to keep texts that a join can't need out of its shuffle.

The sieve is a bitmap of ``2**BITS`` places (16 MB however many ids there are).  It lets every marked id
pass and a few others; the join behind it is exact.  With more ids it lets
more others pass, which costs shuffle but no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 27
PLACES = 1 << BITS
_LOW = 16


def place(column: str) -> Column:
    """An id's place in the bitmap; null ids have one too."""
    return F.pmod(F.xxhash64(column), F.lit(1 << BITS))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for low in batch.column("low"):
            bits = np.zeros(1 << _LOW, dtype=np.uint8)
            bits[low.values.to_numpy()] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.record_batch([batch.column("block"), pa.array(out, pa.binary())], names=["block", "bits"])


def make(ids: DataFrame, column: str) -> Broadcast:
    """The broadcast bitmap of ``ids[column]``."""
    return bitmap(ids.select(place(column).alias("at")))


def bitmap(at: DataFrame) -> Broadcast:
    """The broadcast bitmap of the places ``at``: at most 2**11 rows of 8 KB are gathered for it."""
    blocks = at.groupBy(F.shiftright("at", _LOW).cast("int").alias("block")).agg(
        F.collect_set(F.col("at").bitwiseAND((1 << _LOW) - 1).cast("int")).alias("low"))
    out = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for r in blocks.mapInArrow(_bitmaps, "block int, bits binary").collect():
        size = 1 << (_LOW - 3)
        out[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return at.sparkSession.sparkContext.broadcast(out)


def passes(bitmap: np.ndarray, at: pa.Array) -> np.ndarray:
    """Whether the bitmap is set at each place."""
    at = at.to_numpy(zero_copy_only=False)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sift(rows: DataFrame, bitmap: Broadcast, column: str, let_pass: bool) -> DataFrame:
    """The rows whose id may be marked (``let_pass``), or the others; as one column ``row`` of all columns.

    Only the places go to Python: the rows, with their texts, stay in the JVM.
    """
    def marked(at: pa.Array) -> pa.Array:
        return pa.array(passes(bitmap.value, at))

    ok = F.arrow_udf(marked, "boolean")(place(column))
    return rows.where(ok if let_pass else ~ok).select(F.struct("*").alias("row"))
