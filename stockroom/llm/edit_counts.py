"""Token counts that follow edits: a segment tree of pre-tokens for each document.

Byte-level BPE never merges across pre-tokens, so a text's count is the sum of
its pre-tokens' counts.  The leaves of a document's tree hold a few pre-tokens
each; every node holds the code points and tokens below it.  An edit finds its place by code points,
cuts out the pre-tokens that it touches and those whose end lies within two code points
before it (a pre-token's match looks no further ahead), splits that region
again until a boundary falls on an old one, counts only the new
pre-tokens, and updates the sums above the leaves it changed.

Trees are kept as rows (``plant``): a part holds up to ``PART`` pre-tokens as their text, sizes and counts, and the sums of
them.  ``edit_trees`` applies edits to such rows and gives the trees as they are then, ``edit_figures`` the counts before
and after; neither sees documents.  Only the leaves that an edit reaches are unpacked, and only its new pre-tokens are encoded.

Trees and edits are dealt out by doc_id and read in order, a document's edits first: a task holds one tree and the
edits of one document at a time.  Where a doc_id repeats, each row has a tree of its own and gets the edits.

A null text counts as empty; a null replacement as an empty one.  An edit
with a null start or stop, or without a document, changes nothing.  Places
beyond the text mean its end, a stop before the start means the start.  Edits
of one ``seq`` apply in order of start, stop and replacement; a row that repeats applies again.  Edits of documents that
aren't there are dropped, an empty table of documents gives no rows, other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

RANKS = "byte_bpe_50k.tiktoken"
LEAF = 32
# Pre-tokens in a stored part of a tree: whole leaves.
PART = 128 * LEAF
# Pre-tokens whose counts a worker remembers.
CACHE = 400_000

_ENCODERS: dict[str, "Counter"] = {}


class Counter(dict):
    """Token counts of pre-tokens, remembered."""

    def __init__(self, ranks: str):
        super().__init__()
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                          special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


def counter(ranks: str) -> Counter:
    if ranks not in _ENCODERS:
        _ENCODERS[ranks] = Counter(ranks)
    return _ENCODERS[ranks]


# Marks the width of numbers whose bytes are deflated.
DEFLATED = 0x80


def pack(numbers: list[int]) -> bytes:
    """Whole numbers as bytes: their width, then each of them little-endian in the least width that holds them all, deflated
    if that is shorter."""
    a = np.array(numbers, dtype=np.uint64)
    most = int(a.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    plain = a.astype(f"<u{width}").tobytes()
    short = zlib.compress(plain, 1)
    return bytes([width | DEFLATED]) + short if len(short) < len(plain) else bytes([width]) + plain


def unpack(held: bytes) -> np.ndarray:
    plain = zlib.decompress(held[1:]) if held[0] & DEFLATED else held[1:]
    return np.frombuffer(plain, dtype=f"<u{held[0] & ~DEFLATED}").astype(np.int64)


class Leaves(list):
    """Leaves, each either a list or a function that unpacks it when it is first looked at."""

    def __getitem__(self, i: int) -> list:
        leaf = super().__getitem__(i)
        if callable(leaf):
            leaf = self[i] = leaf()
        return leaf

    def __iter__(self) -> Iterator[list]:
        return (self[i] for i in range(len(self)))


def parts_of(pieces: list[str], costs: list[int]) -> Iterator[tuple[int, int, int, str, bytes, bytes]]:
    """(part, n_chars, n_tokens, text, sizes, counts) of a tree's rows; an empty text has one."""
    for part, i in enumerate(range(0, max(len(pieces), 1), PART)):
        some, cost = pieces[i:i + PART], costs[i:i + PART]
        text = "".join(some)
        yield part, len(text), sum(cost), text, pack(list(map(len, some))), pack(cost)


class Tree:
    """The pre-tokens of a text in leaves, under sums of their code points and tokens."""

    def __init__(self, text: str, count: Counter):
        self.count = count
        self.recounted = 0
        pieces = count.pattern.findall(text)
        self._fill(pieces, [count[p] for p in pieces])

    @classmethod
    def stored(cls, parts: list[tuple[str, bytes, bytes]], count: Counter) -> "Tree":
        """The tree of its (text, sizes, counts) rows; nothing is encoded, and no leaf is unpacked yet."""
        tree = cls.__new__(cls)
        tree.count, tree.recounted = count, 0
        leaves, costs, chars, tokens = Leaves(), Leaves(), [], []
        for text, sizes, counts in parts:
            sizes, counts = unpack(sizes), unpack(counts)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            firsts = np.arange(0, len(sizes), LEAF)
            if len(firsts):
                chars.append(np.add.reduceat(sizes, firsts))
                tokens.append(np.add.reduceat(counts, firsts))
            for i in firsts.tolist():
                leaves.append(_cutter(text, ends[i:i + LEAF + 1]))
                costs.append(counts[i:i + LEAF].tolist)
        tree._sum(leaves or Leaves([[]]), costs or Leaves([[]]), *(np.concatenate(x or [np.zeros(1, np.int64)]) for x in (chars, tokens)))
        return tree

    def _fill(self, pieces: list[str], costs: list[int]) -> None:
        leaves = Leaves([pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]])
        counts = Leaves([costs[i:i + LEAF] for i in range(0, len(costs), LEAF)] or [[]])
        self._sum(leaves, counts, [sum(map(len, leaf)) for leaf in leaves], [sum(c) for c in counts])

    def _sum(self, leaves: Leaves, costs: Leaves, chars, tokens) -> None:
        """The nodes above the leaves, each the sum of the two below it."""
        self.leaves, self.costs = leaves, costs
        self.size = 1 << (len(leaves) - 1).bit_length()
        for name, sums in (("chars", chars), ("tokens", tokens)):
            level = np.zeros(self.size, dtype=np.int64)
            level[:len(sums)] = sums
            levels = [level]
            while len(level) > 1:
                level = level[0::2] + level[1::2]
                levels.append(level)
            setattr(self, name, [0, *np.concatenate(levels[::-1]).tolist()])

    def rows(self) -> Iterator[tuple[int, int, int, str, bytes, bytes]]:
        """The tree's rows, as ``stored`` takes them."""
        return parts_of([p for leaf in self.leaves for p in leaf], [n for leaf in self.costs for n in leaf])

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, at: int) -> tuple[int, int, int]:
        """(leaf, index, code points before it) of the pre-token that holds place ``at``; the end if there is none."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        leaf = min(node - self.size, len(self.leaves) - 1)
        if node - self.size != leaf:
            before = self.n_chars - self.chars[self.size + leaf]
        for i, p in enumerate(self.leaves[leaf]):
            if at - before < len(p):
                return leaf, i, before
            before += len(p)
        return leaf, len(self.leaves[leaf]), before

    def _back(self, leaf: int, i: int) -> tuple[int, int] | None:
        """The pre-token before one."""
        if i:
            return leaf, i - 1
        leaf -= 1
        while leaf >= 0 and not self.leaves[leaf]:
            leaf -= 1
        return (leaf, len(self.leaves[leaf]) - 1) if leaf >= 0 else None

    def _on(self, leaf: int, i: int) -> tuple[int, int] | None:
        """The place itself if it holds a pre-token, or else the next that does."""
        while i >= len(self.leaves[leaf]):
            leaf, i = leaf + 1, 0
            if leaf == len(self.leaves):
                return None
        return leaf, i

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace code points ``start`` to ``stop`` (exclusive) by ``new``."""
        start = min(max(start, 0), self.n_chars)
        stop = min(max(stop, start), self.n_chars)
        leaf, i, before = self._find(start)
        first = (leaf, i)
        begin = before
        # What ends within two places before the edit may have looked at it.
        while (back := self._back(*first)) is not None:
            size = len(self.leaves[back[0]][back[1]])
            if begin + 2 <= start:
                break
            first, begin = back, begin - size
        old, ends, end, at, more = [], [], begin, self._on(*first), 8
        while True:
            while at is not None and (end < stop or more > 0):
                more -= end >= stop
                p = self.leaves[at[0]][at[1]]
                old.append((at, p))
                end += len(p)
                ends.append(end)
                at = self._on(at[0], at[1] + 1)
            held = "".join(p for _, p in old)
            region = held[:start - begin] + new + held[stop - begin:]
            shift = len(new) - (stop - start)
            bounds = {e + shift - begin: n + 1 for n, e in enumerate(ends) if e >= stop}
            pieces, x, taken = [], 0, None
            for m in self.count.pattern.finditer(region):
                pieces.append(m[0])
                x = m.end()
                if x >= start - begin + len(new) and x in bounds and (x + 2 <= len(region) or at is None):
                    taken = bounds[x]
                    break
            if taken is None and at is None:
                taken = len(old)
            if taken is not None:
                break
            more = len(old) + 8
        self.recounted += len(pieces)
        costs = [self.count[p] for p in pieces]
        last = old[taken - 1][0] if taken else None
        if last is None:
            self._put(*first, first[1], pieces, costs)
        elif last[0] == old[0][0][0]:
            self._put(*old[0][0], last[1] + 1, pieces, costs)
        else:
            self._put(*old[0][0], None, pieces, costs)
            for between in range(old[0][0][0] + 1, last[0]):
                self._put(between, 0, None, [], [])
            self._put(last[0], 0, last[1] + 1, [], [])
        if max(len(self.leaves[first[0]]), len(pieces)) > 8 * LEAF:
            self._fill([p for leaf in self.leaves for p in leaf], [n for leaf in self.costs for n in leaf])

    def _put(self, leaf: int, a: int, b: int | None, pieces: list[str], costs: list[int]) -> None:
        """Put pre-tokens in the place of a leaf's ``a`` to ``b`` (exclusive; None: its end), and change the sums above it."""
        gone, spent = self.leaves[leaf][a:b], self.costs[leaf][a:b]
        if not pieces and not gone:
            return
        self.leaves[leaf][a:b] = pieces
        self.costs[leaf][a:b] = costs
        chars, tokens = sum(map(len, pieces)) - sum(map(len, gone)), sum(costs) - sum(spent)
        node = self.size + leaf
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2


def _cutter(text: str, ends: np.ndarray) -> Callable[[], list[str]]:
    def cut() -> list[str]:
        at = ends.tolist()
        return [text[a:b] for a, b in zip(at, at[1:])]
    return cut


_TREES = pa.schema([("doc_id", pa.int64()), ("tree", pa.int64()), ("part", pa.int32()), ("n_chars", pa.int64()),
                    ("n_tokens", pa.int64()), ("text", pa.string()), ("sizes", pa.binary()), ("counts", pa.binary())])
TREES = "doc_id long, tree long, part int, n_chars long, n_tokens long, text string, sizes binary, counts binary"
_FIGURES = pa.schema([("doc_id", pa.int64()), ("n_tokens_before", pa.int64()), ("n_tokens", pa.int64()),
                      ("n_chars", pa.int64()), ("n_edits", pa.int64()), ("n_recounted", pa.int64())])
FIGURES = "doc_id long, n_tokens_before long, n_tokens long, n_chars long, n_edits long, n_recounted long"
# Rows and code points of a batch that goes back to Spark.
BATCH, BATCH_CHARS = 2000, 4 << 20


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[text]) if text is not None else 0
        if len(held) >= BATCH or chars >= BATCH_CHARS:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _plant(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    count = counter(ranks)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc_id, tree, text in zip(*(batch.column(c) for c in ("doc_id", "tree", "text"))):
                pieces = count.pattern.findall(text.as_py() or "")
                key = doc_id.as_py(), tree.as_py()
                for part in parts_of(pieces, [count[p] for p in pieces]):
                    yield *key, *part

    yield from _batches(rows(), _TREES, 5)


def _follow(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[tuple[tuple, int, int, Tree]]:
    """((doc_id, tree), tokens before, edits, tree after) of rows in order: a document's edits, then its trees part by part."""
    count = counter(ranks)
    doc_id, edits, key, parts = None, [], None, []

    def done() -> tuple[tuple, int, int, Tree]:
        tree = Tree.stored(parts, count)
        before = tree.n_tokens
        for edit in edits:
            tree.edit(*edit)
        return key, before, len(edits), tree

    for batch in batches:
        plain = [batch.column(c).to_pylist() for c in ("doc_id", "kind", "a", "b", "c")]
        for row, (i, kind, a, b, c) in enumerate(zip(*plain)):
            text, sizes, counts = (batch.column(n)[row].as_py() for n in ("text", "sizes", "counts"))
            if parts and (kind == 0 or key != (i, a)):
                yield done()
                parts = []
            if i is None or i != doc_id:
                doc_id, edits = i, []
            if kind:
                key = i, a
                parts.append((text, sizes, counts))
            elif b is not None and c is not None:
                edits.append((b, c, text or ""))
    if parts:
        yield done()


def _figures(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    yield from _batches(((key[0], before, tree.n_tokens, tree.n_chars, edits, tree.recounted)
                         for key, before, edits, tree in _follow(batches, ranks)), _FIGURES)


def _edited(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    yield from _batches(((*key, *part) for key, _, _, tree in _follow(batches, ranks) for part in tree.rows()), _TREES, 5)


def plant(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, tree, part, n_chars, n_tokens, text, sizes, counts): the segment trees of documents as rows, to be stored.

    ``docs`` has doc_id and text.  ``tree`` tells rows of one doc_id apart; parts of a tree follow each other.
    """
    ranks = ranks or public_tokenizers.path(RANKS)
    small_batches(docs.sparkSession)
    named = docs.select("doc_id", F.monotonically_increasing_id().alias("tree"), "text")
    return named.mapInArrow(lambda b: _plant(b, ranks), TREES)


def _dealt(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees and edits by doc_id, edits first."""
    small_batches(trees.sparkSession)
    none = F.lit(None).cast("binary")
    rows = trees.select("doc_id", F.lit(1).alias("kind"), F.col("tree").alias("a"), F.col("part").cast("long").alias("b"),
                        F.lit(0).cast("long").alias("c"), "text", "sizes", "counts").unionAll(
        edits.where("doc_id is not null").select(
            "doc_id", F.lit(0), F.col("seq").cast("long"), F.col("start").cast("long"), F.col("stop").cast("long"),
            "replacement", none, none))
    # Rows without a doc_id have no edits and needn't meet.
    return rows.repartition(F.coalesce("doc_id", F.xxhash64("a"))).sortWithinPartitions("doc_id", "kind", "a", "b", "c", "text")


def edit_trees(trees: DataFrame, edits: DataFrame, ranks: str | None = None) -> DataFrame:
    """The stored ``trees`` (of ``plant`` or of this) after ``edits``: doc_id, seq, start, stop and replacement."""
    ranks = ranks or public_tokenizers.path(RANKS)
    return _dealt(trees, edits).mapInArrow(lambda b: _edited(b, ranks), TREES)


def edit_figures(trees: DataFrame, edits: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens_before, n_tokens, n_chars, n_edits, n_recounted) of every stored tree, before and after ``edits``."""
    ranks = ranks or public_tokenizers.path(RANKS)
    return _dealt(trees, edits).mapInArrow(lambda b: _figures(b, ranks), FIGURES)


def follow_edits(docs: DataFrame, edits: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens_before, n_tokens, n_chars, n_edits, n_recounted) of every document.

    ``docs`` has doc_id and text, ``edits`` doc_id, seq, start, stop and
    replacement; other columns are not read.  Places are code points of the
    text as earlier edits left it.  ``n_recounted`` is the number of pre-tokens that edits made anew.
    """
    return edit_figures(plant(docs, ranks), edits, ranks)
