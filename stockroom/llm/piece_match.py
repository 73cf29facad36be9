"""SentencePiece encoding and decoding of a BPE model by suffix-array matching.

No piece of the model reaches over the start of a new word (a space mark after another character)
or a line break, so a text's units, runs of space marks with the characters after them, are
encoded each on its own, once for all its occurrences that a worker remembers.  The new
units of a batch are joined into one text; its suffixes are sorted by as many characters as the longest piece
has; a binary search for every piece gives the range of suffixes that begin with it, that is, all
its occurrences.  These edges are sorted by position and relaxed unit by
unit: beginning from single characters, the neighbours whose join is an edge
of the best score, the leftmost among equals, become one, until no join is left.  Characters without a
piece become byte pieces.

A null text stays null in both directions; an empty one has no ids.  Texts
may be of any length.  The space mark itself in a text reads as a space, as in the model's own library.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import chunks, release_memory, slices, small_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_GAP = 0x10FFFF
# Units whose ids a worker remembers, and the characters of one suffix array.
CACHE = 300_000
INDEX_CHARS = 1 << 18
# Units of up to so many characters are relaxed side by side, longer ones each with a heap.
SHORT = 48
# Bytes of text whose new units are indexed together.
BATCH_BYTES = 3 << 20

_UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_MODELS: dict[str, "Pieces"] = {}


class Pieces:
    """The pieces of a model, and the ids of units, remembered."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {}
        self.byte_of = {}
        usable = []
        for i, p in enumerate(self.text):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                usable.append(i)
        self.hidden = {i for i in range(n) if sp.is_control(i)}
        self.unknown = {i for i in range(n) if sp.is_unknown(i)}
        self.ids = np.array(usable)
        self.scores = np.array([sp.get_score(i) for i in usable])
        self.cost = np.unique(-self.scores, return_inverse=True)[1].astype(np.int64)
        self.length = np.array([len(self.text[i]) for i in usable])
        self.longest = int(self.length.max())
        self.codes = np.full((len(usable), self.longest), -1, dtype=np.int64)
        for row, i in zip(self.codes, usable):
            row[:len(self.text[i])] = [ord(c) for c in self.text[i]]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.text):
            raise ValueError("a piece reaches over the start of a word or line")
        self.known: dict[str, bytes] = {}

    def suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """Places of a text in the order of their next ``longest`` characters.

        Also what the order begins with: its alphabet, and the number made of each suffix's first ``step``
        characters (as places in the alphabet from 1, of ``bits`` bits each), in that order.
        """
        alphabet, rank = np.unique(codes, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        bits = int(len(alphabet) + 1).bit_length()
        # As many characters as fit one number are compared at once, then twice as many with each round.
        step = max(min(62 // bits, self.longest), 1)
        padded = np.concatenate([rank, np.zeros(step, dtype=np.int64)])
        key = np.zeros(len(rank), dtype=np.int64)
        for j in range(step):
            key = (key << bits) | padded[j:j + len(rank)]
        head, wide = key, step
        while True:
            order = np.argsort(key)
            if step >= self.longest:
                return order, alphabet, head[order], wide, bits
            fresh = np.diff(key[order], prepend=-1) != 0
            rank = np.empty(len(key), dtype=np.int64)
            rank[order] = np.cumsum(fresh)
            ahead = np.zeros(len(rank), dtype=np.int64)
            ahead[:-step or None] = rank[step:]
            key = rank * (int(rank.max()) + 1) + ahead
            step *= 2

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place * (longest + 1) + length, piece index) of every piece's every occurrence, by place and length."""
        order, alphabet, head, step, bits = self.suffixes(codes)
        # The beginnings of all pieces are searched as numbers; pieces with other characters don't occur.
        letter = np.searchsorted(alphabet, self.codes)
        letter[letter == len(alphabet)] = 0
        place = np.arange(self.longest)
        inside = place < self.length[:, None]
        there = ((alphabet[letter] == self.codes) | ~inside).all(axis=1)
        number = np.zeros(len(self.ids), dtype=np.int64)
        for j in range(step):
            number = (number << bits) | np.where(inside[:, j], letter[:, j] + 1, 0)
        span = np.int64(1) << (bits * (step - np.minimum(self.length, step)))
        first = np.where(there, np.searchsorted(head, number, "left"), 0)
        last = np.where(there, np.searchsorted(head, number + span, "left"), 0)
        # Longer pieces are searched within the range of their beginnings, all at once.
        more = np.flatnonzero((self.length > step) & (last > first))
        if len(more):
            text = np.concatenate([codes, np.full(self.longest, -2, dtype=np.int64)])

            def search(after: bool) -> np.ndarray:
                """First suffix in range that is not below (``after``: that is above) each piece."""
                low, high = first[more], last[more]
                while (low < high).any():
                    mid = (low + high) // 2
                    suffix = text[order[np.minimum(mid, len(order) - 1)][:, None] + place]
                    differs = (suffix != self.codes[more]) & inside[more]
                    at, row = differs.argmax(axis=1), np.arange(len(more))
                    differ = differs[row, at]
                    goes_on = (differ & (suffix[row, at] < self.codes[more, at])) | (~differ if after else False)
                    goes_on &= low < high
                    low, high = np.where(goes_on, mid + 1, low), np.where(goes_on | (low >= high), high, mid)
                return low

            first[more], last[more] = search(False), search(True)
        n = last - first
        piece = np.repeat(np.arange(len(n)), n)
        at = order[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        key = at * (self.longest + 1) + self.length[piece]
        by_place = np.argsort(key)
        return key[by_place], piece[by_place]

    def learn(self, units: list[str]) -> None:
        """Remember the ids of units."""
        lo = 0
        while lo < len(units):
            hi, size = lo, 0
            while hi < len(units) and (hi == lo or size + len(units[hi]) < INDEX_CHARS):
                size += len(units[hi]) + 1
                hi += 1
            joined = chr(_GAP).join(units[lo:hi])
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            edges = self.occurrences(codes)
            sizes = np.array([len(u) for u in units[lo:hi]])
            starts = np.cumsum(sizes + 1) - sizes - 1
            whole = self.relax_all(codes, starts, sizes, edges)
            for u, s, n, ids in zip(units[lo:hi], starts.tolist(), sizes.tolist(), whole):
                self.known[u] = packed(self.relax(u, self.edges_of(s, n, edges))) if ids is None else ids
            lo = hi

    def _edge(self, edges: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The piece index of the edges from ``start`` to ``end``; -1 where there is none."""
        size = end - start
        key = start * (self.longest + 1) + np.minimum(size, self.longest)
        at = np.minimum(np.searchsorted(edges[0], key), max(len(edges[0]) - 1, 0))
        if not len(edges[0]):
            return np.full(len(start), -1)
        return np.where((edges[0][at] == key) & (size <= self.longest), edges[1][at], -1)

    def edges_of(self, start: int, n: int, edges: tuple[np.ndarray, np.ndarray]) -> dict:
        """One unit's edges (start, end) -> (score, id)."""
        x, y = np.searchsorted(edges[0], [start * (self.longest + 1), (start + n) * (self.longest + 1)]).tolist()
        at, size = np.divmod(edges[0][x:y], self.longest + 1)
        p = edges[1][x:y]
        return {(a - start, a - start + z): (v, i) for a, z, v, i in zip(
            at.tolist(), size.tolist(), self.scores[p].tolist(), self.ids[p].tolist())}

    def relax_all(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
                  edges: tuple) -> list[bytes | None]:
        """The ids of units, one join in every unit at each step; None for long units."""
        none = np.iinfo(np.int64).max
        short = np.flatnonzero((sizes <= SHORT) & (sizes > 0))
        unit = np.repeat(short, sizes[short])
        start = np.arange(len(unit)) - np.repeat(np.cumsum(sizes[short]) - sizes[short], sizes[short]) + starts[unit]
        end = start + 1

        def cost(i: np.ndarray) -> np.ndarray:
            """What joining symbol i and the next one costs; nothing joins across units."""
            j = np.minimum(i + 1, len(unit) - 1)
            p = self._edge(edges, start[i], end[j])
            return np.where((unit[i] == unit[j]) & (i < j) & (p >= 0), self.cost[p], none)

        price = cost(np.arange(len(unit)))
        done = []
        while len(unit):
            head = np.flatnonzero(np.diff(unit, prepend=-1))
            n = np.diff(np.append(head, len(unit)))
            best = np.repeat(np.minimum.reduceat(price, head), n)
            over = best == none
            if over.any():
                done.append((unit[over], start[over], end[over]))
                unit, start, end, price, best = (x[~over] for x in (unit, start, end, price, best))
                if not len(unit):
                    break
            a = np.flatnonzero(price == best)
            a = a[np.diff(unit[a], prepend=-1) != 0]  # the leftmost in each unit
            end[a] = end[a + 1]
            left = np.ones(len(unit), dtype=bool)
            left[a + 1] = False
            unit, start, end, price = (x[left] for x in (unit, start, end, price))
            a -= np.arange(len(a))
            for change in (a, a[a > 0] - 1):
                price[change] = cost(change)
        out: list[bytes | None] = [None] * len(sizes)
        if done:
            unit, start, end = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(start)
            unit, start, end = unit[order], start[order], end[order]
            p = self._edge(edges, start, end)
            head = np.flatnonzero(np.diff(unit, prepend=-1))
            ids, cuts = packed(self.ids[p]), (4 * np.append(head, len(unit))).tolist()
            for u, x, y in zip(unit[head].tolist(), cuts[:-1], cuts[1:]):
                out[u] = ids[x:y]
            bare = np.flatnonzero(p < 0)  # single characters without a piece
            for u in np.unique(unit[bare]).tolist():
                x = int(np.searchsorted(unit, u))
                y = int(np.searchsorted(unit, u, "right"))
                out[u] = packed([i for j in range(x, y) for i in (
                    [self.ids[p[j]]] if p[j] >= 0 else self.bytes_of(chr(codes[start[j]])))])
        return out

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]

    def relax(self, unit: str, edges: dict[tuple[int, int], tuple[float, int]]) -> list[int]:
        """The ids of a unit from its edges (start, end) -> (score, id)."""
        end = list(range(1, len(unit) + 1))  # of the symbol that starts at each place; 0: none does
        back = list(range(-1, len(unit) - 1))
        heap = [(-edges[i, i + 2][0], i, i + 1, i + 2) for i in range(len(unit) - 1) if (i, i + 2) in edges]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or b >= len(unit) or end[b] != c:
                continue  # one of the two has changed meanwhile
            end[a], end[b] = c, 0
            if c < len(unit):
                back[c] = a
                if end[c] and (a, end[c]) in edges:
                    heapq.heappush(heap, (-edges[a, end[c]][0], a, c, end[c]))
            p = back[a]
            if p >= 0 and (p, c) in edges:
                heapq.heappush(heap, (-edges[p, c][0], p, a, c))
        out, i = [], 0
        while i < len(unit):
            if (i, end[i]) in edges:
                out.append(edges[i, end[i]][1])
            else:
                out += self.bytes_of(unit[i:end[i]])
            i = end[i]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of texts, each packed as 32-bit numbers."""
        split = [None if t is None else _UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        fresh = list(set().union(*(units for units in split if units)).difference(self.known))
        self.learn(fresh)
        get = self.known.__getitem__
        out = [None if units is None else b"".join(map(get, units)) for units in split]
        for u in fresh:
            if len(u) > SHORT:  # long ones hardly come again
                del self.known[u]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, control ids are left out."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i not in self.hidden:
                out.append(" ⁇ " if i in self.unknown else self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).removeprefix(SPACE).replace(SPACE, " ")


def packed(ids) -> bytes:
    return np.asarray(ids, dtype="<i4").tobytes()


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode_texts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text; other columns are not read).

    ``model`` is a path that every worker can read.
    """
    model = model or public_tokenizers.path(MODEL)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=BATCH_BYTES):
            ids = pieces(model).encode(part.column("text").to_pylist())
            ends = np.cumsum([0] + [len(x or b"") // 4 for x in ids]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join([x or b"" for x in ids]), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in ids]))
            yield pa.record_batch([part.column("doc_id"), lists], names=["doc_id", "ids"])
        release_memory()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of rows with doc_id and ids; null ids are left out of a row's list."""
    model = model or public_tokenizers.path(MODEL)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            if lists.values.null_count:
                lists = pa.array([x and [i for i in x if i is not None] for x in lists.to_pylist()], lists.type)
            flat = lists.values.to_numpy()
            texts = [at and pieces(model).decode(flat[at[0]:at[1]].tolist()) for at in slices(lists)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())],
                                  names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, ids array<int>, text string")
