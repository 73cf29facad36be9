"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words of one document.  Every word covered by a
window whose word sequence also starts in a document with a smaller doc_id is
removed.  Windows are judged on the input, not on what is left.

1. A map task takes its documents in chunks.  Within a chunk, windows are
   sorted and every one that a smaller doc_id of the chunk also has is decided
   there and then; only the first holders of a window go on.  So a passage in
   a third of all documents leaves each chunk once.
2. Consecutive undecided windows that share a minimiser (the least hash of the
   ``m``-word runs inside a window) travel as one packed string to the
   minimiser's bucket.  Equal windows have equal minimisers, so they meet.
   The strings of a chunk for one bucket are one compressed row.
   What every bucket would get is counted first.  A bucket over twice the aim (a
   frequent ``m``-word run) is split: its windows are dealt, each by the hash of
   its ``k`` words, to further buckets.  Equal windows still meet.
3. A bucket sorts its windows by hash, compares the words of equal hashes, and
   reports every window for which a smaller doc_id exists.
4. Covered ranges go back to their documents by doc_id.

Nulls: a null text has no words; a row with a null doc_id has no place in the
order, so it neither removes words nor loses any.  Rows that repeat a doc_id
don't remove each other's words; each is judged by its own text.  Texts with
fewer than ``k`` words keep all of them.  An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..session import cut_lineage
from . import sieve
from .common import (Words, chunks, mix64, release_memory, run_hashes, shuffle_partitions, sliding_min, small_batches, slices, utf8,
                     word_hashes, words_of)

K_WORDS = 13
MINIMISER_WORDS = 4
# Of the compression of packed strings.
LEVEL = 6
# Bytes of packed strings that a bucket holds on average; more text makes more buckets, and one with over twice as
# much is split.
BUCKET_BYTES = 6 << 20

_RANGES = "doc_id long, text_key int, start int, n int"


def repeated_windows(w: Words, hashes: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(valid, later): whether a window of ``k`` words starts at each word, and whether its
    word sequence also starts in a text with a smaller id.  ``hashes`` are the words'; equality is exact."""
    n = len(w.start)
    valid, later = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n < k:
        return valid, later
    valid[: n - k + 1] = w.owner[: n - k + 1] == w.owner[k - 1:]
    at = np.flatnonzero(valid)
    if not len(at):
        return valid, later
    h = run_hashes(hashes, k, 11)[at]
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    same = h[1:] == h[:-1]
    if not same.any():
        return valid, later
    group = np.concatenate([[0], np.cumsum(~same)])
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    at, group = at[shared], group[shared]
    doc = ids[w.owner[at]]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    heads = np.flatnonzero(head)
    which = np.cumsum(head) - 1
    # Equal hashes are compared word by word with the group's first window.
    buf, s = w.buf.tobytes(), w.start[at]
    e = w.start[at + k - 1] + w.size[at + k - 1]
    first = heads[which]
    equal = np.empty(len(at), dtype=bool)
    for lo in range(0, len(at), 1 << 15):
        part = slice(lo, lo + (1 << 15))
        equal[part] = [buf[a:b] == buf[c:d] for a, b, c, d in zip(
            s[part].tolist(), e[part].tolist(), s[first[part]].tolist(), e[first[part]].tolist())]
    least = np.minimum.reduceat(doc, heads)
    if equal.all():
        later[at] = doc > least[which]
    else:  # different words under one hash: those groups by their words
        bad = np.unique(which[~equal])
        fine = ~np.isin(which, bad)
        later[at[fine]] = doc[fine] > least[which[fine]]
        for g in bad.tolist():
            best: dict[bytes, int] = {}
            rows = np.flatnonzero(which == g).tolist()
            for r in rows:
                key = buf[s[r]:e[r]]
                best[key] = min(best.get(key, int(doc[r])), int(doc[r]))
            for r in rows:
                later[at[r]] = int(doc[r]) > best[buf[s[r]:e[r]]]
    return valid, later


def _runs(flag: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of set flags; a run goes on from i-1 to i where ``joined[i]``."""
    on = np.flatnonzero(flag)
    if not len(on):
        return on, on
    fresh = np.ones(len(on), dtype=bool)
    fresh[1:] = (np.diff(on) != 1) | ~joined[on[1:]]
    begin = np.flatnonzero(fresh)
    return on[begin], np.diff(np.append(begin, len(on)))


def _pack(doc: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray, body: bytes) -> bytes:
    """Ranges or strings of a chunk: its documents once, then the document, place and size of each, then the text."""
    pairs, of = np.unique(np.stack([doc, key], axis=1), axis=0, return_inverse=True) if len(doc) else (
        np.zeros((0, 2), dtype=np.int64), doc)
    head = struct.pack("<II", len(pairs), len(doc))
    # byte planes: upper bytes are mostly zero and vanish in compression
    planes = np.stack([of.ravel(), start, size]).astype("<u4").view(np.uint8).reshape(3, -1, 4).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=LEVEL).compress(
        head + pairs[:, 0].astype("<i8").tobytes() + pairs[:, 1].astype("<i4").tobytes() + planes.tobytes() + body)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    docs, n = struct.unpack_from("<II", raw)
    doc, key = np.frombuffer(raw, "<i8", docs, 8), np.frombuffer(raw, "<i4", docs, 8 + 8 * docs)
    at = 8 + 12 * docs
    of, start, size = np.frombuffer(raw, np.uint8, 12 * n, at).reshape(3, 4, n).transpose(0, 2, 1).copy().view(
        "<u4").reshape(3, n).astype(np.int64)
    return doc[of], key[of], start, size, raw[at + 12 * n:]


def _deal(w: Words, hashes: np.ndarray, buckets: int, split: np.ndarray | None, extra: int, k: int, m: int) -> np.ndarray:
    """The bucket of the window at each word: by its minimiser, or by its ``k`` words where that bucket's place is set in
    the bitmap ``split``."""
    out = np.zeros(len(w.start), dtype=np.int64)
    inner = sliding_min(run_hashes(hashes, m, 23), k - m + 1)
    dest = (mix64(inner) % np.uint64(buckets)).astype(np.int64)
    if split is not None:
        own = sieve.passes(split, pa.array(dest & (sieve.PLACES - 1)))
        dest[own] = buckets + (run_hashes(hashes, k, 37)[own] % np.uint64(extra)).astype(np.int64)
    out[: len(dest)] = dest
    return out


def _strings(w: Words, windows: np.ndarray, dest: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(first word, bucket, first byte, last byte + 1) of the strings that ``windows`` travel in."""
    joined = near.copy()
    joined[1:] &= dest[1:] == dest[:-1]
    s, n = _runs(windows, joined)
    last = s + n + k - 2
    return s, dest[s], w.start[s], w.start[last] + w.size[last]


def _near(w: Words) -> np.ndarray:
    """Whether the word before each word is of the same text."""
    return np.concatenate([[False], w.owner[1:] == w.owner[:-1]]) if len(w.owner) else np.zeros(0, dtype=bool)


def bucket_loads(batches: Iterator[pa.RecordBatch], buckets: int, k: int, m: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, size, alone): bytes that a chunk's strings bring to a bucket, and bytes of their windows one by one."""
    for part in chunks(batches):
        w = words_of(utf8(part.column("text")))
        hashes = word_hashes(w)
        valid, later = repeated_windows(w, hashes, part.column("doc_id").to_numpy(zero_copy_only=False), k)
        windows = valid & ~later
        dest = _deal(w, hashes, buckets, None, 1, k, m)
        _, bucket, a, b = _strings(w, windows, dest, _near(w), k)
        at = np.flatnonzero(windows)
        # Only the buckets of this chunk are counted, however many there are.
        on, string = np.unique(bucket, return_inverse=True)
        size = np.bincount(string, b - a + 1, len(on))
        alone = np.bincount(np.searchsorted(on, dest[at]), w.start[at + k - 1] + w.size[at + k - 1] - w.start[at] + 1, len(on))
        if len(on):
            yield pa.record_batch([pa.array(on.astype(np.int32)), pa.array(size.astype(np.int64)),
                                   pa.array(alone.astype(np.int64))], names=["bucket", "size", "alone"])
        release_memory()


def super_kmers(batches: Iterator[pa.RecordBatch], buckets: int, k: int, m: int,
                split: np.ndarray | None = None, extra: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, decided, blob) of documents (doc_id, text_key, text)."""
    schema = pa.schema([("bucket", pa.int32()), ("decided", pa.bool_()), ("blob", pa.binary())])
    for part in chunks(batches):
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        keys = part.column("text_key").to_numpy(zero_copy_only=False)
        w = words_of(utf8(part.column("text")))
        hashes = word_hashes(w)
        valid, later = repeated_windows(w, hashes, ids, k)
        rows: list[tuple[int, bool, bytes]] = []
        near = _near(w)
        s, n = _runs(later, near)
        if len(s):
            o = w.owner[s]
            rows.append((int(ids[o[0]] % buckets), True, _pack(ids[o], keys[o], s - w.first[o], n, b"")))
        s, bucket, a, b = _strings(w, valid & ~later, _deal(w, hashes, buckets, split, extra, k, m), near, k)
        if len(s):
            order = np.argsort(bucket, kind="stable")
            s, bucket, a, b = s[order], bucket[order], a[order], b[order]
            o = w.owner[s]
            buf = w.buf.tobytes()
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(s)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                body = b" ".join([buf[i:j] for i, j in zip(a[x:y].tolist(), b[x:y].tolist())])
                rows.append((int(bucket[x]), False, _pack(
                    ids[o[x:y]], keys[o[x:y]], s[x:y] - w.first[o[x:y]], b[x:y] - a[x:y], body)))
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        release_memory()


def judge_bucket(rows: pa.Table, k: int) -> pa.Table:
    """Covered ranges (doc_id, text_key, first word of the first window, windows) from one bucket's blobs."""
    doc, key, start, size, body, out = [], [], [], [], [], []
    for decided, blob in zip(rows.column("decided").to_pylist(), rows.column("blob").to_pylist()):
        d, t, s, n, text = _unpack(blob)
        if decided:
            out.append((d, t, s, n))
        else:
            for held, x in zip((doc, key, start, size), (d, t, s, n)):
                held.append(x)
            body.append(text)
    if doc:
        doc, key, start, size = (np.concatenate(x) for x in (doc, key, start, size))
        # The packed strings are texts of their own, cut out of the joined bodies.
        w = words_of([b" ".join(body)])
        body = None
        begins = np.searchsorted(w.start, np.cumsum(size.astype(np.int64) + 1) - size - 1, "left")
        w.first = np.append(begins, len(w.start))
        w.owner = np.repeat(np.arange(len(doc)), np.diff(w.first))
        _, later = repeated_windows(w, word_hashes(w), doc, k)
        s, n = _runs(later, np.concatenate([[False], w.owner[1:] == w.owner[:-1]]))
        o = w.owner[s]
        out.append((doc[o], key[o], start[o] + (s - w.first[o]), n))
    w = body = None
    release_memory()
    cols = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, dtype=np.int64) for i in range(4)]
    return pa.table({name: pa.array(c.astype(kind)) for name, c, kind in zip(
        ("doc_id", "text_key", "start", "n"), cols, ("i8", "i4", "i4", "i4"))})


def covered_ranges(docs: DataFrame, k: int = K_WORDS, m: int = MINIMISER_WORDS) -> DataFrame:
    """Windows to remove, as ranges: (doc_id, text_key, start, n) are ``n`` windows from word ``start`` on.

    ``text_key`` is a hash of the text and tells rows apart that repeat a doc_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_window = (k + (k - m + 2) / 2) / ((k - m + 2) / 2)  # packed words for each word of input, about
    buckets = max(shuffle_partitions(spark), int(total * per_window / BUCKET_BYTES) + 1)
    over = cut_lineage(known.mapInArrow(lambda batches: bucket_loads(batches, buckets, k, m), "bucket int, size long, alone long")
                       .groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("alone").alias("alone"))
                       .where(F.col("size") > 2 * BUCKET_BYTES).coalesce(shuffle_partitions(spark)))
    # Full buckets are told by a bitmap of fixed size.  Beyond its places, another bucket may be split too, which loses nothing.
    split = sieve.bitmap(over.select(F.pmod(F.col("bucket").cast("long"), F.lit(sieve.PLACES)).alias("at")))
    extra = (over.agg(F.sum("alone")).first()[0] or 0) // BUCKET_BYTES + 1
    packed = known.withColumn("text_key", F.hash("text")).mapInArrow(
        lambda batches: super_kmers(batches, buckets, k, m, split.value, extra),
        "bucket int, decided boolean, blob binary")
    return packed.groupBy("bucket").applyInArrow(lambda rows: judge_bucket(rows, k), _RANGES)


def _finish(text: bytes | None, start: np.ndarray, n: np.ndarray, k: int) -> tuple[int, int, str]:
    """(words, removed words, the words left joined by one space) of a text and its covered ranges."""
    words = (text or b"").split()
    if not len(start):
        return len(words), 0, b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n + k - 1, -1)
    hit = (np.cumsum(edge[:-1]) > 0).tolist()
    return len(words), sum(hit), b" ".join([x for x, y in zip(words, hit) if not y]).decode()


_OUT = "doc_id long, text string, n_words long, n_removed long, kept_text string"


def _finished(texts: pa.Array, ranges: pa.Array | None, k: int) -> list[tuple[int, int, str]]:
    none = np.zeros(0, dtype=np.int64)
    if ranges is None:
        return [_finish(t, none, none, k) for t in utf8(texts)]
    start, n = (ranges.values.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
    return [_finish(t, start[at[0]:at[1]], n[at[0]:at[1]], k) if at else _finish(t, none, none, k)
            for t, at in zip(utf8(texts), slices(ranges))]


def _result(part: pa.RecordBatch, ranges: pa.Array | None, k: int) -> pa.RecordBatch:
    total, gone, kept = zip(*_finished(part.column("text"), ranges, k))
    return pa.record_batch([part.column("doc_id"), part.column("text"), pa.array(total, pa.int64()),
                            pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                           names=["doc_id", "text", "n_words", "n_removed", "kept_text"])


def _apply(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        yield _result(part, part.column("ranges"), k)


def _apply_none(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The documents that the sieve holds back, which have no ranges."""
    for part in chunks(batches):
        rest = part.filter(pa.array(~sieve.passes(bitmap, part.column("at"))))
        if rest.num_rows:
            yield _result(rest, None, k)


def _ranges_of(docs: DataFrame, k: int, m: int) -> tuple[DataFrame, Broadcast]:
    """(rows that may have covered words with their ``ranges``, the sieve that holds back all others); ``row`` has
    the columns of docs.

    Only the former meet the ranges in a join; a fixed-size sieve of doc_ids tells them from the rest.
    """
    ranges = cut_lineage(covered_ranges(docs, k, m).groupBy("doc_id", "text_key")
                         .agg(F.collect_list(F.struct("start", "n")).alias("ranges")))
    bitmap = sieve.make(ranges, "doc_id")
    keyed = sieve.sift(docs, bitmap, "doc_id", True).select(
        "row", F.col("row.doc_id").alias("doc_id"), F.hash("row.text").alias("text_key"))
    return keyed.join(ranges, ["doc_id", "text_key"], "left").select("row", "ranges"), bitmap


def drop_repeated_passages(docs: DataFrame, k: int = K_WORDS, m: int = MINIMISER_WORDS) -> DataFrame:
    """The documents (doc_id, text) with n_words, n_removed and kept_text, the words left joined by one space.

    ``docs`` may hold other columns; they are not read.
    """
    docs = docs.select("doc_id", "text")
    touched, bitmap = _ranges_of(docs, k, m)
    others = docs.withColumn("at", sieve.place("doc_id")).mapInArrow(lambda b: _apply_none(b, bitmap.value, k), _OUT)
    return touched.select("row.doc_id", "row.text", "ranges").mapInArrow(lambda b: _apply(b, k), _OUT).unionAll(others)


def clean_texts(docs: DataFrame, k: int = K_WORDS, m: int = MINIMISER_WORDS) -> DataFrame:
    """``docs`` without the words of repeated passages: all columns, ``text`` made new where it loses words (the rest
    joined by one space); documents that lose all their words go."""
    touched, bitmap = _ranges_of(docs, k, m)
    others = sieve.sift(docs, bitmap, "doc_id", False)
    kind = StructType([touched.schema["row"], StructField("left", IntegerType()), StructField("new", StringType())])
    hit = touched.where("ranges is not null").withColumn("text", F.col("row.text")).mapInArrow(
        lambda b: _shorten(b, k), kind).where("left > 0")
    same = touched.where("ranges is null").select("row").unionAll(others).select("row.*")
    return same.unionAll(hit.select(*[
        F.col("new").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]))


def _shorten(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        total, gone, kept = zip(*_finished(part.column("text"), part.column("ranges"), k))
        yield pa.record_batch([part.column("row"), pa.array(np.subtract(total, gone), pa.int32()), pa.array(kept, pa.string())],
                              names=["row", "left", "new"])
        release_memory()
