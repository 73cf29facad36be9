"""Secret scan: keyword automaton first, anchored expressions only where it hits, then checksums.

One Aho-Corasick automaton over all keywords reads each whole text once.  An expression is
tried only at a hit's own place, so no expression searches the text.  Kinds:

* ``assign``, ``access``, ``hex``: the base kinds (fixed patterns below), leftmost and
  non-overlapping within a kind; matches that are too short are dropped after
  they have used up their text.  ``hex`` has no keyword; its runs are found by one scan for
  long runs of hex digits.
* ``github``, ``npm``: prefixed tokens of 36 letters and digits of which the last six are the
  CRC-32 of the first thirty in base 62; only tokens whose checksum holds are reported.

Spans are in code points, the end exclusive, ordered by start and then kind.
A null text counts as empty; a null doc_id is kept as it is; rows that repeat are scanned each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, utf8

# Kinds in their order, their keywords and patterns.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
PREFIXED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS = 6, 20
MASK = b"[REDACTED]"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MACHINE: list[ahocorasick.Automaton] = []


def _machine() -> ahocorasick.Automaton:
    if not _MACHINE:
        a = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                a.add_word(word, (kind, len(word)))
        a.make_automaton()
        _MACHINE.append(a)
    return _MACHINE[0]


def checksum(body: bytes) -> bytes:
    """The six base-62 digits of a token body's CRC-32."""
    n, out = zlib.crc32(body), bytearray()
    for _ in range(6):
        n, digit = divmod(n, 62)
        out.append(BASE62[digit])
    return bytes(out[::-1])


def scan(raw: bytes) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in bytes of a UTF-8 text, by start and then kind."""
    found: list[tuple[int, int, str]] = []
    after = dict.fromkeys(KINDS, 0)
    # Latin-1 keeps one character for each byte; all keywords are ASCII. Hits come in order of their
    # ends; within a kind all keywords that can overlap start in that order too, or are sorted below.
    hits = [(end - size + 1, kind) for end, (kind, size) in _machine().iter(raw.translate(_LOWER).decode("latin-1"))]
    for at, kind in sorted(hits):
        if at < after[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(raw, at)
            good = m is not None and len(m[2]) >= MIN_ASSIGN
        elif kind == "access":
            m = ACCESS.match(raw, at)
            good = m is not None and m.end() - at >= MIN_ACCESS
        else:
            m = PREFIXED.match(raw, at)
            good = m is not None and not (at and raw[at - 1:at].isalnum()) and checksum(m[1]) == m[2]
        if m is not None:
            after[kind] = m.end()
            if good:
                found.append((at, m.end(), kind))
    found += [(*m.span(), "hex") for m in HEX.finditer(raw)]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


def in_code_points(raw: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The same spans counted in code points."""
    if not spans or raw.isascii():
        return spans
    place, seen, chars = {}, 0, 0
    for p in sorted({x for s in spans for x in s[:2]}):
        chars += len(raw[seen:p].decode())
        seen = p
        place[p] = chars
    return [(place[a], place[b], kind) for a, b, kind in spans]


def redact(raw: bytes) -> bytes:
    """The text with every span replaced by a mask; spans that overlap become one."""
    out, at = [], 0
    for a, b, _ in scan(raw):
        if a >= at:
            out += [raw[at:a], MASK]
        at = max(at, b)
    return b"".join([*out, raw[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        spans = []
        for raw in utf8(part.column("text")):
            raw = raw or b""
            spans.append([{"kind": k, "start": a, "end": b} for a, b, k in in_code_points(raw, scan(raw))])
        yield pa.record_batch([part.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text; other columns are not read)."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _scan_batches, "doc_id long, spans array<struct<kind: string, start: long, `end`: long>>")


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        texts = [None if raw is None else redact(raw) for raw in utf8(part.column("text"))]
        yield pa.record_batch([part.column("row"), pa.array(texts, pa.binary()).cast(pa.string())], names=["row", "text"])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with its secrets masked in ``text``; a null text stays null, other columns stay as they are."""
    small_batches(docs.sparkSession)
    packed = docs.select(F.struct("*").alias("row"), "text")
    done = packed.mapInArrow(_redact_batches, packed.schema)
    return done.select([F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
