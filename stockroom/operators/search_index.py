"""Substring search by an inverted index of character trigrams of the displayed cells.

An index row is (Gram, Cell, and the key columns as lists): three neighbouring characters of a cell's lower-case text, the cell's
place among the searched columns, and up to ``LIST`` rows that show it.  A task lists the rows that it reads, some ten thousand at a
time, so what is shuffled, sorted and stored is a few bytes for each trigram of a cell, not a row.  A term of three or more characters can only be in cells that hold all its trigrams: those
rows are looked up, and each is then checked exactly, so results are those of ``parties.search_rows``.  Shorter terms have no trigram
and scan.  Characters are code points; ``%`` and ``_`` are characters like others.

The index lies in ranges of (Gram, first key of a list): a lookup reads only ranges of the term's trigrams, and a frequent trigram spans many of them.
Rows that repeat a key are found by what any of them shows; keys may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import any_contains_ci
from .parties import search_rows

GRAM = 3
# Keys of one list, and bytes of rows that a task lists at a time.
LIST = 1024
CHUNK_BYTES = 4 << 20


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, points of each); null texts are empty."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    place = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, 4 * texts.offset)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[place[0]:place[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    try:
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    except UnicodeDecodeError:
        shown = [t.decode("utf-8", "replace") for t in texts.to_pylist()]
        return np.frombuffer("".join(shown).encode("utf-32-le"), "<u4"), np.fromiter(map(len, shown), np.int64, len(shown))
    return points, np.diff(np.append(0, np.cumsum((raw & 0xC0) != 0x80))[place - place[0]])


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the code points of each distinct trigram of every text, the text), sorted by both."""
    points, size = _points(texts)
    text = np.repeat(np.arange(len(size)), size)
    seen = np.unique(points)
    wide, bits = max(int(len(seen) - 1).bit_length(), 1), int(len(size)).bit_length()
    if 3 * wide + bits > 63 and len(size) > 1:  # so many characters that a trigram and its text don't fit one number
        half = len(size) // 2
        (a, x), (b, y) = _grams(texts[:half]), _grams(texts[half:])
        code, text = np.concatenate([a, b]), np.concatenate([x, y + half])
        order = np.lexsort((text, code[:, 2], code[:, 1], code[:, 0]))
        return code[order], text[order]
    letter = np.searchsorted(seen, points)
    n = max(len(points) - (GRAM - 1), 0)
    at = np.flatnonzero(text[:n] == text[GRAM - 1:])
    both = (letter[at] << 2 * wide | letter[at + 1] << wide | letter[at + 2]) << bits | text[at]
    both.sort()
    both = both[np.diff(both, prepend=-1) != 0]
    code, low = both >> bits, (1 << wide) - 1
    return seen[np.stack([code >> 2 * wide, code >> wide & low, code & low], axis=1)], both & ((1 << bits) - 1)


def _cuts(other: np.ndarray) -> np.ndarray:
    """Where lists begin, of at most ``LIST`` each, where ``other`` tells rows that differ from the one before (but the first)."""
    begin = np.flatnonzero(np.append(True, other))
    place = np.arange(len(other) + 1) - np.repeat(begin, np.diff(np.append(begin, len(other) + 1)))
    return np.flatnonzero(place % LIST == 0)


def _listed(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Lists of the rows (``key`` columns, then lower-case texts) of each chunk by trigram and cell."""
    for rows in _chunks(batches):
        for cell in range(rows.num_columns - key):
            code, row = _grams(rows.column(key + cell).combine_chunks())
            if not len(code):
                continue
            cut = _cuts((code[1:] != code[:-1]).any(axis=1))
            gram = ["".join(map(chr, c)) for c in code[cut].tolist()]
            ends = pa.array(np.append(cut, len(code)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, rows.column(i).combine_chunks().take(pa.array(row))) for i in range(key)]
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.string()), pa.array(np.full(len(gram), cell), pa.int32()), *lists],
                                             names=["Gram", "Cell", *rows.column_names[:key]])


def _relisted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of neighbouring postings (Gram, Cell, key columns) of equal trigram and cell."""
    for rows in _chunks(batches):
        if not rows.num_rows:
            continue
        gram, cell = (rows.column(c).combine_chunks() for c in ("Gram", "Cell"))
        cut = _cuts((np.diff(gram.dictionary_encode().indices.to_numpy()) != 0) | (np.diff(cell.to_numpy()) != 0))
        ends = pa.array(np.append(cut, rows.num_rows), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, rows.column(i).combine_chunks()) for i in range(2, rows.num_columns)]
        yield pa.RecordBatch.from_arrays([gram.take(pa.array(cut)), cell.take(pa.array(cut)), *lists], names=rows.column_names)


def _kind(rows: DataFrame, key: list[str]) -> StructType:
    return StructType([StructField("Gram", StringType()), StructField("Cell", IntegerType()),
                       *[StructField(k, ArrayType(rows.schema[k].dataType)) for k in key]])


def _lists(rows: DataFrame, key: list[str], cells: list[str]) -> DataFrame:
    n = len(key)
    shown = rows.select(*key, *[F.lower(F.col(c).cast("string")).alias(f"_{i}") for i, c in enumerate(cells)])
    return shown.mapInArrow(lambda b: _listed(b, n), _kind(rows, key))


def _postings(index: DataFrame, key: list[str]) -> DataFrame:
    """(Gram, Cell, key columns): a row for each key of a list."""
    return index.select("Gram", "Cell", F.explode(F.arrays_zip(*key)).alias("k")).select("Gram", "Cell", *[f"k.{k}" for k in key])


def build_index(rows: DataFrame, key: list[str], cells: list[str]) -> DataFrame:
    """The trigrams of every row's ``cells``, in ranges of (Gram, first key); store them sorted so.  ``rows`` are read twice."""
    first = [F.col(k)[0] for k in key]
    return _lists(rows, key, cells).repartitionByRange("Gram", *first).sortWithinPartitions("Gram", *first)


def _same(rows: DataFrame, keys: DataFrame, key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [rows[k].eqNullSafe(keys[f"_{k}"]) for k in key])


def _keys(keys: DataFrame, key: list[str]) -> DataFrame:
    return keys.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()


def reindexed(index: DataFrame, key: list[str], cells: list[str], gone: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """The stored ``index`` after rows were deleted (``gone``: their keys) and ``rows`` were written; an edited row is in both."""
    if gone is not None:
        keys, held = _keys(gone, key), _postings(index, key)
        left = held.join(keys, _same(held, keys, key), "left_anti").sortWithinPartitions("Gram", "Cell", *key)
        index = left.mapInArrow(_relisted, _kind(left, key))
    return index if rows is None else index.unionAll(_lists(rows, key, cells).select(*index.columns))


def indexed_search(rows: DataFrame, index: DataFrame, term: str, key: list[str], cells: list[str]) -> DataFrame:
    """Rows of which any cell contains ``term``, ignoring case."""
    low = term.lower()
    grams = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not grams:
        return search_rows(rows, term, cells)
    hits = _postings(index.where(F.col("Gram").isin(grams)), key).distinct()
    found = _keys(hits.groupBy(*key, "Cell").count().where(F.col("count") == len(grams)), key)
    return rows.join(found, _same(rows, found, key), "left_semi").where(any_contains_ci(cells, term))
