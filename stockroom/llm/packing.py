"""Packing into token windows by Karmarkar-Karp multiway differencing.

A document's ids are those of the tokenizer, then an end id.  Full windows are
cut off as sequences of their own; the tail is cut into parts of at most
``part`` ids.  Parts are gathered, in a task, until they fill ``windows`` windows, and are
divided by differencing: of all partial partitions the two with the largest
imbalance are merged, the largest sum of one with the smallest of the other,
until one is left with near-equal windows.  If a window exceeds its capacity,
the count of windows rises by one and the group is divided again.

Every task packs the rows it reads, without a shuffle; sequence ids carry the
task's partition number in their upper bits.  A null text counts as empty and
holds the end id only; rows that repeat are packed each.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import chunks, small_batches

WINDOW = 2048
PART = 512
GROUP_WINDOWS = 128
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"

_ENCODERS: dict[str, object] = {}


def encode(text: str, vocabulary: str, ranks: str) -> np.ndarray:
    """The tokenizer's ids.  The same vocabulary as ranks gives the same ids several times faster; texts that
    hold the special token's string go to the tokenizer itself."""
    if SPECIAL in text:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Tokenizer.from_file(vocabulary)
        return np.array(_ENCODERS[vocabulary].encode(text, add_special_tokens=False).ids, dtype="<u4")
    if ranks not in _ENCODERS:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[ranks] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                             special_tokens={})
    return np.array(_ENCODERS[ranks].encode_ordinary(text), dtype="<u4")


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` groups of indexes whose sums are near equal."""
    # A partial partition: its non-empty windows as (sum, members), largest first; members is a nested pair.
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        if len(b) <= free:
            merged = a + b
        else:  # b's largest take the free windows, the rest join a's smallest, opposed
            merged = a[:len(a) - (len(b) - free)] + b[:free]
            merged += [(x + y, (p, q)) for (x, p), (y, q) in zip(a[len(a) - (len(b) - free):], b[free:][::-1])]
            # opposed: a's largest of these meets b's smallest
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], order, merged))
        order += 1
    groups = []
    for _, members in heap[0][2] if heap else []:
        out, stack = [], [members]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                out.append(x)
        groups.append(sorted(out))
    return groups


def divide(sizes: list[int], window: int) -> list[list[int]]:
    """Groups of indexes of at most ``window`` in sum; the fewest windows that differencing can keep to."""
    k = max(-(-sum(sizes) // window), 1)
    while True:
        groups = difference(sizes, k)
        if all(sum(sizes[i] for i in g) <= window for g in groups):
            return groups
        k += 1


def cut(n: int, window: int, part: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(full windows, parts of the tail) of ``n`` ids, as (start, length)."""
    full = n // window * window
    tail = n - full
    pieces = -(-tail // part)
    edges = [full + tail * i // pieces for i in range(pieces + 1)] if pieces else []
    return [(s, window) for s in range(0, full, window)], [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                     ("ids", pa.list_(pa.int32()))])


def _pack(batches: Iterator[pa.RecordBatch], window: int, part: int, windows: int, vocabulary: str, ranks: str,
          keep_ids: bool) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 33
    sequence = 0
    rows: list[tuple] = []
    tails: list[tuple] = []
    held = 0
    schema = _PIECES if keep_ids else pa.schema(list(_PIECES)[:-1])

    def place(group: list[tuple]) -> None:
        nonlocal sequence
        offset = 0
        for piece in group:
            rows.append((*piece[:5], base + sequence, offset, *piece[5:]))
            offset += piece[2]
        sequence += 1

    def flush() -> None:
        nonlocal tails, held
        for group in divide([t[2] for t in tails], window) if tails else []:
            place([tails[i] for i in group])
        tails, held = [], 0

    def out() -> pa.RecordBatch:
        nonlocal rows
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows = []
        return batch

    for batch in chunks(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = np.append(encode(text or "", vocabulary, ranks), np.uint32(END_ID)).astype("<u4")
            full, rest = cut(len(ids), window, part)
            for start, size in full + rest:
                x = ids[start:start + size]
                piece = (doc_id, start, size, zlib.crc32(x.tobytes()), len(ids), *([x] if keep_ids else []))
                if size == window:
                    place([piece])
                else:
                    if held + size > windows * window:
                        flush()
                    tails.append(piece)
                    held += size
            if len(rows) >= 20_000:
                yield out()
    flush()
    if rows:
        yield out()


def pack(docs: DataFrame, window: int = WINDOW, part: int = PART, windows: int = GROUP_WINDOWS,
         vocabulary: str | None = None, ranks: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of ``docs`` (doc_id, text).

    ``vocabulary`` and ``ranks`` are paths of one vocabulary in two forms, present on every worker.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    ranks = ranks or public_tokenizers.path(RANKS)
    kind = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
            + ", ids array<int>" * keep_ids)
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        lambda b: _pack(b, window, part, windows, vocabulary, ranks, keep_ids), kind)
