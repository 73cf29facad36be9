"""Shared pieces of the text operators: table reads, words of a batch as numpy arrays, 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+``, the runs between ASCII white space, as
``bytes.split()`` cuts them.  A batch of texts is turned into one buffer of
words with a single space after each, so that a run of words is a slice of it.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

# Texts are worked on in chunks of about this many bytes, which bounds a Python worker's memory.
CHUNK_BYTES = 4 << 20
# Rows and bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
# Hashing goes through a buffer in slabs of this many bytes.
SLAB_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python in Arrow batches of at most ``BATCH_BYTES`` and ``BATCH_ROWS``: a batch stands
    in memory several times, in the JVM and in each worker.  Smaller settings of the session stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that their order and remainders are as good as random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """The words of a list of texts.

    ``buf``: all words, each followed by one space; ``start``/``size``: byte
    place of each word in ``buf``; ``first``: index of each text's first word
    (one entry more than texts); ``owner``: the text of each word.
    """

    buf: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    owner: np.ndarray

    def slice(self, a: int, b: int) -> bytes:
        """Words ``a`` to ``b`` (inclusive), joined by one space."""
        return self.buf[self.start[a]: self.start[b] + self.size[b]].tobytes()


def words_of(texts: list[bytes | None], lower: bool = False) -> Words:
    """The words of UTF-8 texts (None: none); ``lower`` turns A-Z into a-z first."""
    raw = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    begin = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)
    keep = ~space
    keep[end] = True
    buf = raw[keep]
    if lower:
        buf = _LOWER[buf]
    size = end - begin
    after = np.cumsum(size + 1)
    start = after - size - 1
    buf = buf.copy() if not buf.flags.writeable else buf
    buf[start + size] = 32
    at = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    first = np.searchsorted(begin, at, "left")
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(buf, start, size, first, owner)


_POWERS = np.ones(1, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C55)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 256), _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    n = len(w.start)
    out = np.empty(n, dtype=np.uint64)
    if not n:
        return out
    powers = _powers(int(w.size.max()) + 2)
    lo = 0
    while lo < n:
        hi = max(int(np.searchsorted(w.start, w.start[lo] + SLAB_BYTES, "left")), lo + 1)
        a, b = int(w.start[lo]), int(w.start[hi - 1] + w.size[hi - 1] + 1)
        offsets = w.start[lo:hi] - a
        place = np.arange(b - a) - np.repeat(offsets, w.size[lo:hi] + 1)
        out[lo:hi] = np.add.reduceat((w.buf[a:b].astype(np.uint64) + np.uint64(1)) * powers[place], offsets)
        lo = hi
    return mix64(out)


def run_hashes(word_hash: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive words (also across texts: mask those by owner)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    c = odd_constants(k, seed)
    total = word_hash[:n] * c[0]
    for j in range(1, k):
        total += word_hash[j:n + j] * c[j]
    return mix64(total)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every ``k`` consecutive values."""
    n = len(x) - k + 1
    if n <= 0:
        return x[:0]
    width, best = 1, x
    while width * 2 <= k:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    return np.minimum(best[:n], best[k - width:k - width + n])


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by rows into pieces of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def release_memory() -> None:
    """Give freed memory back to the system: Spark uses a Python worker again, which would keep its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library frees by itself
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(column: pa.Array) -> Iterator[tuple[int, int] | None]:
    """Where each list of a list column begins and ends in its flat values; None for a null."""
    ends = column.offsets.to_pylist()
    for a, b, valid in zip(ends[:-1], ends[1:], column.is_valid().to_pylist()):
        yield (a, b) if valid else None


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()
