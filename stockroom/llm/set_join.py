"""N-gram Jaccard self-join by a partitioned universe, with exact verification.

A document's set holds the distinct 5-word shingles of its lower-cased (A-Z)
words, as 64-bit hashes; with fewer words, the whole sequence as one; without
words or text it is empty and linked with nothing.  Two documents link when
``100 * |intersection| >= 75 * |union|``.

Pigeonhole.  Sets of sizes l <= s that link differ in at most H = floor(2s/7)
elements (for 75 of 100).  Sizes are cut into bands; each band hashes the
universe into its own number of segments.  The larger set (the probe) spends
H + 1 units over segments: one unit finds partners whose subset there is
equal, two units also find those that differ by one element.  As there are more
units than differences, one of the paid segments must find the partner.

* Index rows: the hash of every non-empty segment subset, and in every sixteenth segment
  its one-deletion neighbours, in the set's own band and in the next
  one if a larger partner may lie there.
* Allocation: a unit's cost is the number of sets that could be its partners, counted over the whole
  corpus: no larger, not too small, and with the same row; for the second unit of a segment, a subset here that is a
  one-deletion neighbour there, or the other way about.  As the second unit of a segment needs its first, it costs at least as much.
  A set pays for its H + 1 cheapest units of both kinds.  Units without any partner are free; a set with H + 1 of
  those has no link to a set no larger and is done.  Empty segments are never paid for.
* Sets that lack units even so (a rare accident of hashing) take an exact side
  path: any partner's first floor(l/4) + 1 elements hold one of theirs.

Groups under one row are never expanded into all pairs at first: each payer is compared with the
group's hub, the member that shares most rows with others, such as the original of a family of edited copies.
Links are verified on the full sets and their components found.  Another round takes
hubs from other components of the group.  What is in one component already needs no more pairs; the
rest, payers and members of groups that are still in more than one component, are gathered by the component of the
first hub of their group, dealt into blocks of sets, and every block of payers meets every block of
members as one row with their sets, whose overlaps are counted by one matrix product.

Rows with equal sets are one class, named by its least doc_id, and never compared; links and components
are those of classes.  Sets are told apart by 96 bits.  Rows that repeat a
doc_id share its component; a null doc_id takes no part and gets a null one.  An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, free_unused
from . import sieve
from .common import (chunks, mix64, odd_constants, release_memory, run_hashes, shuffle_partitions, small_batches, utf8,
                     word_hashes, words_of)
from .components import components

SHINGLE = 5
NUM, DEN = 75, 100
# A chunk that a task works on at once, in bytes of text.
TASK_BYTES = 4 << 20
# Bytes of text that make one more bucket, which holds two to four million rows.  A set's key goes once to each
# bucket that it has rows for, so fewer buckets shuffle less.
BUCKET_TEXT = 18 << 20
# Rounds of hubs before the rest is compared member by member.
HUB_ROUNDS = 2
# Sets of one block, when the rest is compared, and bytes of its sets on average.
BLOCK_SETS, BLOCK_BYTES = 512, 8 << 20
# One segment of so many has one-deletion neighbours too.
DELETION_EVERY = 16

_U = np.uint64
_SEG = odd_constants(3, 41)


@dataclass(frozen=True)
class Plan:
    """Size bands, and for each the number of segments."""

    num: int
    den: int
    bounds: tuple[int, ...]
    segments: tuple[int, ...]

    def differences(self, s: np.ndarray) -> np.ndarray:
        """Most elements in which a set of size s and one no larger differ if they link."""
        return 2 * s * (self.den - self.num) // (self.den + self.num)

    def band(self, s: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.asarray(self.bounds), s, "right") - 1

    def largest_partner(self, s: np.ndarray) -> np.ndarray:
        return s * self.den // self.num


def make_plan(num: int = NUM, den: int = DEN, longest: int = 1 << 40) -> Plan:
    """Bands grow by the square of the largest size ratio of a link, so a set lies in one or two.

    A band gets the fewest segments that leave its largest sets, with a margin
    for the chance of the hashing, the units they need.
    """
    ratio = (den / num) ** 2
    bounds, segments = [1], []
    while bounds[-1] <= longest:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * ratio)))
    for low, high in zip(bounds[:-1], bounds[1:]):
        most = high - 1
        need = 2 * most * (den - num) // (den + num) + 1
        m = max(2 * need, 4)
        for step in (1.25, 1.02):
            trial = need if step > 1.2 else int(m / 1.25)
            while True:
                trial = max(trial + 1, int(trial * step))
                held = trial * (1 - np.exp(-most / trial))
                if held >= need + 3 * np.sqrt(held) + 1 or trial >= 64 * most:
                    m = trial
                    break
        segments.append(int(m))
    return Plan(num, den, tuple(bounds[:-1]), tuple(segments))


PLAN = make_plan()


def shingles(texts: list[bytes | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle hash), distinct, sorted by both."""
    w = words_of(texts, lower=True)
    if not len(w.start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    wh = word_hashes(w)
    count = np.diff(w.first)
    owners, hashes = [], []
    for n in range(1, k + 1):
        h = run_hashes(wh, n, 100 + n)
        at = np.arange(len(h))
        ok = w.owner[: len(h)] == w.owner[n - 1:] if len(h) else np.zeros(0, dtype=bool)
        if n < k:  # a text of n words, whole
            ok = ok & (count[w.owner[: len(h)]] == n)
        owners.append(w.owner[at[ok]])
        hashes.append(h[ok])
    o, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(h)
    narrow = np.uint16 if len(texts) <= 1 << 16 else np.int64
    order = order[np.argsort(o[order].astype(narrow), kind="stable")]
    o, h = o[order], h[order]
    fresh = np.ones(len(o), dtype=bool)
    fresh[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return o[fresh], h[fresh]


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=_U)
    if len(values):
        at = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[at]] = np.add.reduceat(values, at)
    return out


def set_keys(texts: list[bytes | None], k: int = SHINGLE):
    """(owner, hash, size, key1, key2): the sets, and a 96-bit hash of each, in 64 and 32 bits."""
    o, h = shingles(texts, k)
    n = len(texts)
    size = np.bincount(o, minlength=n).astype(np.int64) if len(o) else np.zeros(n, dtype=np.int64)
    one = mix64(_sums(mix64(h ^ _SEG[0]), o, n) + size.astype(_U))
    two = mix64(_sums(mix64(h ^ _SEG[1]), o, n) ^ size.astype(_U))
    return o, h, size, one.view(np.int64), (two >> _U(32)).astype(np.uint32).view(np.int32)


def _rank_within(group: np.ndarray) -> np.ndarray:
    """Place of each row within its group of equal neighbours."""
    at = np.flatnonzero(np.diff(group, prepend=-1))
    return np.arange(len(group)) - np.repeat(at, np.diff(np.append(at, len(group))))


# What a row of a set says: it stands in the set's own band; its segment has deletions too; it is a deletion.
OWN, GIVES, DELETION = 1, 2, 4


def segment_rows(o: np.ndarray, h: np.ndarray, size: np.ndarray, plan: Plan):
    """(set, row hash, flags, segment) of every row, each set's numbers of first and second units, and whether it lacks units."""
    n = len(size)
    held = size > 0
    own = plan.band(np.maximum(size, 1))
    far = plan.band(plan.largest_partner(np.maximum(size, 1)))
    need = plan.differences(size) + 1
    segments = np.asarray(plan.segments)
    mixed = mix64(h ^ _SEG[2])
    none = np.zeros(0, dtype=np.int64)
    owners, rows, flags, places = [none], [none.astype(_U)], [none.astype(np.int8)], [none]
    firsts, seconds = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for step in range(int((far - own)[held].max(initial=0)) + 1 if held.any() else 0):
        level = own + step
        use = (level <= far)[o]
        oo, x = o[use], mixed[use]
        if not len(oo):
            continue
        count = segments[np.minimum(level, len(segments) - 1)][oo].astype(_U)
        seg = ((h[use] >> _U(17)) % count).astype(np.int64)
        order = np.argsort(oo * (int(seg.max()) + 1) + seg)
        oo, x, seg = oo[order], x[order], seg[order]
        first = np.ones(len(oo), dtype=bool)
        first[1:] = (oo[1:] != oo[:-1]) | (seg[1:] != seg[:-1])
        at = np.flatnonzero(first)
        owner, total, cnt = oo[at], np.add.reduceat(x, at), np.diff(np.append(at, len(oo)))
        place = mix64(level[owner].astype(_U) * _SEG[0] + seg[at].astype(_U) * _SEG[1])
        gives = (seg[at] % DELETION_EVERY == 0) & (cnt >= 2)
        which = np.repeat(np.arange(len(at)), cnt)
        cut = gives[which]
        which = which[cut]
        flag = np.zeros(len(at), dtype=np.int8)
        if step == 0:
            firsts, seconds = np.bincount(owner, minlength=n), np.bincount(owner[gives], minlength=n)
            flag = OWN + np.where(gives, GIVES, 0).astype(np.int8)
        owners += [owner, owner[which]]
        rows += [mix64(total + place), mix64(total[which] - x[cut] + place[which])]
        flags += [flag, flag[which] | DELETION]
        places += [seg[at], seg[at][which]]
    poor = held & (firsts + seconds < need)
    return (np.concatenate(owners), np.concatenate(rows), np.concatenate(flags).astype(np.int8), np.concatenate(places),
            firsts, seconds, poor)


_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("n", pa.int64()), ("blob", pa.binary())])
# The columns of each kind of row that a bucket passes on; key1 and key2 become one ``key`` of 12 bytes.
_COLUMNS = {
    "base": (("doc_id", "<i8"), ("known", "<i1"), ("key1", "<i8"), ("key2", "<i4"), ("n_shingles", "<i8"),
             ("firsts", "<i8"), ("seconds", "<i8")),
    "poor": (("doc_id", "<i8"), ("key1", "<i8"), ("key2", "<i4"), ("size", "<i8")),
    "unit": (("grp", "<i8"), ("key1", "<i8"), ("key2", "<i4"), ("size", "<i8"), ("cost", "<i8"), ("segment", "<i8"),
             ("second", "<i1")),
    "member": (("grp", "<i8"), ("key1", "<i8"), ("key2", "<i4"), ("size", "<i8")),
}
_SQL = {"<i8": "long", "<i4": "int", "<i1": "byte"}
# Bits of a row hash that are kept beside its bucket; false meetings, one for some thousand rows, are verified away.
_KEPT_BITS = 32


# Rows that one partition of a table of names and groups holds.
ROWS_PER_PART = 1 << 16


def _pack(kind: str, *columns) -> tuple[str, int, bytes]:
    body = b"".join(np.asarray(c).astype(t).tobytes() for c, (_, t) in zip(columns, _COLUMNS[kind]))
    return kind, len(columns[0]), zstandard.ZstdCompressor(level=1).compress(struct.pack("<Q", len(columns[0])) + body)


def _keys(one: np.ndarray, two: np.ndarray) -> pa.Array:
    """Both parts of keys as 12 bytes each."""
    flat = np.empty(len(one), dtype=[("one", "<i8"), ("two", "<i4")])
    flat["one"], flat["two"] = one, two
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(12), len(one), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in no more partitions than they need: fewer and larger files of every shuffle behind it."""
    return df.coalesce(max(1, min(shuffle_partitions(df.sparkSession), -(-rows // ROWS_PER_PART))))


def unpacked(found: DataFrame, kind: str, groups: Broadcast | None = None) -> DataFrame:
    """The rows of one kind; with the bitmap ``groups`` of the last bits of group names, only rows of groups that it lets pass.

    They are held back here and not by a sieve behind, which would be a second Python worker of each task.
    """
    columns = [(c, t) for c, t in _COLUMNS[kind] if c not in ("key1", "key2")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                raw = zstandard.ZstdDecompressor().decompress(blob)
                n, at, out = struct.unpack_from("<Q", raw)[0], 8, {}
                for c, t in _COLUMNS[kind]:
                    out[c] = np.frombuffer(raw, t, n, at)
                    at += n * np.dtype(t).itemsize
                if groups is not None:
                    ok = sieve.passes(groups.value, pa.array(out["grp"] & (sieve.PLACES - 1)))
                    out = {c: x[ok] for c, x in out.items()}
                yield pa.record_batch([_keys(out["key1"], out["key2"]), *(pa.array(out[c]) for c, _ in columns)],
                                      names=["key", *(c for c, _ in columns)])
        release_memory()

    return found.where(F.col("kind") == kind).mapInArrow(
        rows, "key binary, " + ", ".join(f"{c} {_SQL[t]}" for c, t in columns))


def signatures(batches: Iterator[pa.RecordBatch], buckets: int, plan: Plan, k: int) -> Iterator[pa.RecordBatch]:
    """Compressed rows of a chunk: its segment rows for each bucket (equal sets are sent once), its sets' sizes
    and hashes, and its sets without units."""
    pack = zstandard.ZstdCompressor(level=1)
    for part in chunks(batches, limit=TASK_BYTES):
        known = ~np.asarray(part.column("doc_id").is_null())
        ids = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        o, h, size, one, two = set_keys(utf8(part.column("text")), k)
        to = int(ids[0] % buckets)
        order = np.lexsort((ids, ~known, two, one))
        again = np.zeros(len(ids), dtype=bool)
        again[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        again |= ~known
        keep = ~again[o]
        owner, row, flags, segment, firsts, seconds, poor = segment_rows(o[keep], h[keep], np.where(again, 0, size), plan)
        out = [(to, *_pack("base", ids, known, one, two, size, firsts, seconds))]
        bucket = (row % _U(buckets)).astype(np.int64)
        rest = (row // _U(buckets)) & _U((1 << _KEPT_BITS) - 1)
        order = np.argsort(bucket * (1 << _KEPT_BITS) + rest.astype(np.int64)) if buckets < 1 << 22 else np.lexsort(
            (rest, bucket))
        owner, bucket, rest, flags, segment = (x[order] for x in (owner, bucket, rest, flags, segment))
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(bucket)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            there, local = np.unique(owner[x:y], return_inverse=True)
            steps = np.diff(rest[x:y], prepend=_U(0)).astype("<u4")
            body = struct.pack("<II", len(there), y - x) + b"".join(
                v[there].astype(t).tobytes() for v, t in ((one, "<i8"), (two, "<i4"), (size, "<i4")))
            # byte planes of the steps: the upper ones are zero and vanish in compression
            body += steps.view(np.uint8).reshape(-1, 4).T.tobytes()
            body += local.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + flags[x:y].tobytes()
            body += segment[x:y][flags[x:y] & GIVES > 0].astype("<u4").tobytes()
            out.append((int(bucket[x]), "rows", y - x, pack.compress(body)))
        bad = np.flatnonzero(poor)
        if len(bad):
            out.append((to, *_pack("poor", ids[bad], one[bad], two[bad], size[bad])))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)
        release_memory()


def meet(rows: pa.Table, num: int, den: int) -> pa.Table:
    """From one bucket: 'unit' rows of first and second units with partners and their cost, and the 'member' rows of their
    groups; other kinds of rows pass through."""
    one, two, size, rest, flags, segment = [], [], [], [], [], []
    out, unpack = [], zstandard.ZstdDecompressor()
    for kind, n, blob in zip(*(rows.column(c).to_pylist() for c in ("kind", "n", "blob"))):
        if kind != "rows":
            out.append((kind, n, blob))
            continue
        raw = unpack.decompress(blob)
        n, m = struct.unpack_from("<II", raw)
        a, b, s = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i4", n, 8 + 8 * n), np.frombuffer(raw, "<i4", n, 8 + 12 * n)
        at = 8 + 16 * n
        steps, local = np.frombuffer(raw, np.uint8, 8 * m, at).reshape(2, 4, m).transpose(0, 2, 1).copy().view("<u4").reshape(2, m)
        one.append(a[local])
        two.append(b[local])
        size.append(s[local])
        rest.append(np.cumsum(steps, dtype=np.uint32))
        flags.append(np.frombuffer(raw, np.int8, m, at + 8 * m))
        place = np.full(m, -1, dtype=np.int32)
        gives = flags[-1] & GIVES > 0
        place[gives] = np.frombuffer(raw, "<u4", int(gives.sum()), at + 9 * m)
        segment.append(place)
    if rest:
        bucket = rows.column("bucket")[0].as_py()
        one, two, size, rest, flags, segment = (np.concatenate(x) for x in (one, two, size, rest, flags, segment))
        order = np.argsort(rest, kind="stable")
        near = rest[order]
        same = near[1:] == near[:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        one, two, size, rest, flags, segment = (x[order] for x in (one, two, size, rest, flags, segment))
        # one row for each set and kind of row, by size within a row hash
        kind = flags & DELETION
        order = np.lexsort((kind, two, one, size, rest))
        one, two, size, rest, flags, segment, kind = (x[order] for x in (one, two, size, rest, flags, segment, kind))
        fresh = np.ones(len(rest), dtype=bool)
        fresh[1:] = (rest[1:] != rest[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (kind[1:] != kind[:-1])
        one, two, size, rest, flags, segment, kind = (x[fresh] for x in (one, two, size, rest, flags, segment, kind))
        if len(rest):
            grp = np.cumsum(np.concatenate([[True], rest[1:] != rest[:-1]])) - 1
            name = mix64(rest.astype(_U) * _U(2) + np.full(1, bucket, dtype=_U) * _SEG[0]).view(np.int64)
            size = size.astype(np.int64)
            wide = int(size.max()) + 1
            whole, gone = np.flatnonzero(kind == 0), np.flatnonzero(kind)
            places = {0: grp[whole] * wide + size[whole], DELETION: grp[gone] * wide + size[gone]}
            least = grp * wide + -(-size * num // den)
            # Partners of a first unit stand before it, from the least size that can link on.
            first = np.arange(len(whole)) - np.searchsorted(places[0], least[whole], "left")
            paying = (first >= 1) & (flags[whole] & OWN > 0)
            chosen = [(whole[paying], first[paying], 0)]
            # Partners of a second unit are rows of the other kind.
            for mine, other in ((whole, DELETION), (gone, 0)):
                own = mine[flags[mine] & GIVES > 0]
                met = np.searchsorted(places[other], grp[own] * wide + size[own], "right") - np.searchsorted(
                    places[other], least[own], "left")
                chosen.append((own[met > 0], met[met > 0], 1))
            for u, cost, second in chosen:
                if len(u):
                    out.append(_pack("unit", name[u], one[u], two[u], size[u], cost, segment[u], np.full(len(u), second)))
            used = np.zeros(int(grp[-1]) + 1, dtype=np.int8)
            used[grp[chosen[0][0]]] = 1
            for u, _, _ in chosen[1:]:
                used[grp[u]] = 2  # of such a group deletions are members too
            m = np.flatnonzero((used[grp] == 2) | ((used[grp] == 1) & (kind == 0)))
            if len(m):
                out.append(_pack("member", name[m], one[m], two[m], size[m]))
    release_memory()
    return pa.table([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()),
                     pa.array([x[2] for x in out], pa.binary())], names=["kind", "n", "blob"])


def allocate(units: list[dict], units_of_set: int, need: int) -> list[int]:
    """The groups that a set must search, of its ``units`` with partners (cost, second, segment, grp).

    ``units_of_set`` counts all units that it has, with partners or without.
    """
    firsts = {u["segment"] if u["segment"] >= 0 else -2 - i: (u["cost"], [u["grp"]])
              for i, u in enumerate(units) if not u["second"]}
    seconds: dict[int, tuple[int, list[int]]] = {}
    for u in units:
        if u["second"]:
            cost, groups = seconds.get(u["segment"], (0, []))
            seconds[u["segment"]] = cost + u["cost"], [*groups, u["grp"]]
    # The second unit of a segment comes after its first; one without partners of its own is had with the first.
    priced = [(cost, 0, groups) for cost, groups in firsts.values()]
    for place in {*seconds, *(p for p in firsts if p >= 0)}:
        cost, groups = seconds.get(place, (0, []))
        priced.append((max(cost, firsts[place][0] if place in firsts else 0), 1, groups))
    short = need - (units_of_set - len(priced))
    return [g for _, _, groups in sorted(priced, key=lambda p: p[:2])[:max(short, 0)] for g in groups]


def _paid(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows (grp, key, size, doc) of the units that sets pay for."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        need = (plan.differences(sizes) + 1).tolist()
        have = (batch.column("firsts").to_numpy() + batch.column("seconds").to_numpy()).tolist()
        groups = [allocate(u, h, k) for u, h, k in zip(batch.column("units").to_pylist(), have, need)]
        at = pa.array(np.repeat(np.arange(batch.num_rows), [len(g) for g in groups]))
        yield pa.record_batch([pa.array([g for x in groups for g in x], pa.int64()), *(
            batch.column(c).take(at) for c in ("key", "size", "doc"))], names=["grp", "key", "size", "doc"])
    release_memory()


def _sets(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pa.array(sieve.passes(bitmap, batch.column("at"))))
        for part in chunks([batch]):
            o, h, size, one, two = set_keys(utf8(part.column("text")), k)
            ends = np.cumsum(size)
            held = [h[e - s:e].tobytes() for s, e in zip(size.tolist(), ends.tolist())]
            yield pa.record_batch([_keys(one, two), pa.array(held, pa.binary())], names=["key", "held"])
            release_memory()


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            common = int((b[at] == a).sum()) if len(b) else 0
            ok.append(den * common >= num * (len(a) + len(b) - common) and common > 0)
        yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))
    release_memory()


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(key, held): the shingle sets of the documents of ``ids`` (doc) and a few others, each once; checkpointed,
    and dealt by key once for all the joins (what an executor loses of that is dealt again)."""
    bitmap = sieve.make(ids.withColumnRenamed("doc", "doc_id"), "doc_id")
    sets = cut_lineage(docs.withColumn("at", sieve.place("doc_id")).mapInArrow(
        lambda b: _sets(b, bitmap.value, k), "key binary, held binary"))
    dealt = sets.repartition(shuffle_partitions(docs.sparkSession), "key")
    return dealt.dropDuplicates(["key"]).persist(StorageLevel.MEMORY_AND_DISK)


def _links(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, a_key, b, b_key) whose sets link, as (u, v); checkpointed.

    Sets of ``a`` travel to those of ``b``; rows of one ``a`` stand together, so its copies compress well.  An ``a`` with more
    than a task's share of the pairs is salted; there are fewer of those than tasks.
    """
    spark = pairs.sparkSession
    tasks = shuffle_partitions(spark)
    per = pairs.groupBy("a_key").agg(F.count("*").alias("n"))
    share = -(-(per.agg(F.sum("n")).first()[0] or 0) // tasks)
    # As an Arrow table: a list of rows would go through Python workers of another kind, which stay beside the others.
    hot = spark.createDataFrame(per.where(F.col("n") > max(share, 1)).select(
        "a_key", F.ceil(F.col("n") / max(share, 1)).cast("int").alias("salts")).toArrow(), "a_key binary, salts int")
    firsts = sets.toDF("a_key", "x")
    plain = pairs.join(F.broadcast(hot), "a_key", "left_anti").join(firsts, "a_key")
    spread = firsts.join(F.broadcast(hot), "a_key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    salted = pairs.join(F.broadcast(hot), "a_key").withColumn("salt", F.pmod(F.xxhash64("b_key"), F.col("salts")).cast("int"))
    columns = ["a", "b", "b_key", "x"]
    met = plain.select(columns).unionAll(salted.drop("salts").join(spread.drop("salts"), ["a_key", "salt"]).select(columns))
    both = met.join(sets.toDF("b_key", "y"), "b_key").select("a", "b", "x", "y")
    return cut_lineage(both.mapInArrow(lambda b: _verify(b, num, den), "a long, b long").toDF("u", "v"))


def _n_blocks():
    """The number of blocks of a family's sets, of 8 bytes for each element."""
    return F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("size") * 8 / BLOCK_BYTES)).cast("int")


def _blocks(rows: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(family, <name>_block, <name>): rows (family, doc, key, size, component) and their sets in blocks."""
    n = rows.groupBy("family").agg(_n_blocks().alias(f"n_{name}"))
    return (rows.join(n, "family").join(sets, "key")
            .withColumn(f"{name}_block", F.pmod(F.hash("key"), F.col(f"n_{name}")))
            .groupBy("family", f"{name}_block").agg(
                F.collect_list(F.struct("doc", "size", "component", "held")).alias(name)))


def _cross(payers: DataFrame, members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) of payers and members of one family that are in different components."""
    n = members.groupBy("family").agg(_n_blocks().alias("n"))
    p = _blocks(payers, sets, "p").join(n, "family").withColumn("m_block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = _blocks(members, sets, "m").join(p, ["family", "m_block"]).select("p", "m")
    return cut_lineage(pairs.mapInArrow(lambda b: _cross_batches(b, num, den), "u long, v long").distinct())


def _cross_batches(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            a, b = (batch.column(c).slice(i, 1).flatten() for c in ("p", "m"))
            (doc_a, size_a, in_a), (doc_b, size_b, in_b) = (
                [x.field(c).to_numpy() for c in ("doc", "size", "component")] for x in (a, b))
            held_a, held_b = ([np.frombuffer(v, _U) for v in x.field("held").to_pylist()] for x in (a, b))
            common = np.zeros((len(doc_a), len(doc_b)), dtype=np.float64)
            # The elements of the first block in strips, so that the matrices stay small.
            elements = np.unique(np.concatenate(held_a))
            for lo in range(0, len(elements), 4096):
                strip = elements[lo:lo + 4096]
                x, y = (_incidence(held, strip) for held in (held_a, held_b))
                common += x @ y.T
            total = size_a[:, None] + size_b[None, :]
            hit = (in_a[:, None] != in_b[None, :]) & (den * common >= num * (total - common)) & (common > 0)
            u, v = np.nonzero(hit)
            if len(u):
                yield pa.record_batch([pa.array(doc_a[u]), pa.array(doc_b[v])], names=["u", "v"])


def _incidence(held: list[np.ndarray], strip: np.ndarray) -> np.ndarray:
    out = np.zeros((len(held), len(strip)), dtype=np.float32)
    for row, x in zip(out, held):
        x = x[np.searchsorted(x, strip[0]):np.searchsorted(x, strip[-1], "right")]
        at = np.searchsorted(strip, x)
        row[at[strip[at] == x]] = 1
    return out


def _repeats(base: DataFrame, names: DataFrame, rows: int) -> DataFrame | None:
    """Links (u, v) between the classes of rows that share a doc_id; None if no rows do."""
    many = cut_lineage(narrow(base.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), rows))
    if many.isEmpty():
        return None
    ids = base.where("n_shingles > 0").join(many, "doc_id", "left_semi").select("doc_id", "key").distinct()
    of = ids.join(names.select("key", "doc"), "key").select("doc_id", "doc")
    return of.join(of.groupBy("doc_id").agg(F.min("doc").alias("least")), "doc_id").select(
        F.col("doc").alias("u"), F.col("least").alias("v"))


def link_components(docs: DataFrame, plan: Plan = PLAN, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text; other columns are not read)."""
    spark = docs.sparkSession
    num, den = plan.num, plan.den
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id is not null and text is not null")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), int(total / BUCKET_TEXT) + 1)
    found = cut_lineage(
        docs.mapInArrow(lambda b: signatures(b, buckets, plan, k), "bucket int, kind string, n long, blob binary")
        .groupBy("bucket").applyInArrow(lambda t: meet(t, num, den), "kind string, n long, blob binary"))
    rows = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.sum("n").alias("n")).collect()}

    def part(kind: str, groups: Broadcast | None = None) -> DataFrame:
        return narrow(unpacked(found, kind, groups), rows.get(kind, 0))

    base = cut_lineage(part("base").withColumn("doc_id", F.expr("if(known = 1, doc_id, null)")).drop("known"))
    # Each class of equal sets by its least doc_id, with its numbers of units.
    n_base = rows.get("base", 0)
    names = cut_lineage(narrow(base.where("n_shingles > 0 and doc_id is not null").groupBy("key").agg(
        F.min("doc_id").alias("doc"), F.max("firsts").alias("firsts"), F.max("seconds").alias("seconds")), n_base))
    units = part("unit").groupBy("key").agg(F.max("size").alias("size"), F.collect_list(
        F.struct("cost", "second", "segment", "grp")).alias("units"))
    paid = cut_lineage(narrow(units.join(names, "key").mapInArrow(
        lambda b: _paid(b, plan), "grp long, key binary, size long, doc long").distinct(), rows.get("unit", 0)))
    # Members of groups that no set pays for, more than half of them, go before any shuffle; a member's degree is counted
    # where it meets its name.
    groups = sieve.bitmap(paid.select(F.col("grp").bitwiseAND(sieve.PLACES - 1).alias("at")))
    member = part("member", groups).join(paid.select("grp").distinct(), "grp", "left_semi")
    degree = F.count("*").over(Window.partitionBy("key")).alias("degree")
    member = cut_lineage(narrow(member.select("*", degree).join(names.select("key", "doc"), "key"), rows.get("member", 0)))
    pairs = _poor_pairs(known, part("poor").distinct(), names, k, num, den) if rows.get("poor") else None
    sets = _sets_of(known, member.select("doc") if pairs is None else member.select("doc").union(
        pairs.select(F.explode(F.array("a", "b")).alias("doc"))), k)
    free_unused(spark)

    def placed(rows: DataFrame, linked: DataFrame) -> DataFrame:
        return (rows.join(linked.withColumnRenamed("node", "doc"), "doc", "left")
                .withColumn("component", F.coalesce("component", "doc")))

    def met(payers: DataFrame, hubs: DataFrame) -> DataFrame:
        """Payers and the hubs of their groups, as pairs of sets that could link."""
        near = (F.col("size") * den >= F.col("hub.size") * num) & (F.col("hub.size") * den >= F.col("size") * num)
        pairs = payers.join(hubs, "grp").where(near & (F.col("key") != F.col("hub.key"))).select(
            F.col("hub.doc").alias("a"), F.col("hub.key").alias("a_key"), F.col("doc").alias("b"), F.col("key").alias("b_key"))
        return cut_lineage(narrow(pairs.distinct(), n_base))

    def joined(linked: DataFrame, links: DataFrame) -> DataFrame:
        """The components that ``linked`` has after more links: found between its components, which are fewer than the links."""
        between = placed(links.withColumnRenamed("u", "doc"), linked).select(
            F.col("component").alias("u"), F.col("v").alias("doc"))
        between = placed(between, linked).select("u", F.col("component").alias("v"))
        more = components(between, n_base).toDF("component", "to")
        moved = linked.join(more, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        new = more.select(F.col("component").alias("node"), F.col("to").alias("component")).join(
            linked.select("node"), "node", "left_anti")
        return cut_lineage(narrow(moved.unionAll(new), n_base))

    best = F.max(F.struct("degree", "key", "doc", "size")).alias("hub")
    hubs = cut_lineage(narrow(member.groupBy("grp").agg(best), rows.get("member", 0)))
    links = _links(sets, met(paid, hubs), num, den)
    if pairs is not None:
        links = links.unionAll(_links(sets, pairs, num, den))
    repeats = _repeats(base, names, n_base)
    linked = cut_lineage(narrow(components(links if repeats is None else links.unionAll(repeats), n_base), n_base))
    first_hubs = placed(hubs.select("grp", F.col("hub.doc").alias("doc")), linked).select("grp", F.col("component").alias("family"))
    free_unused(spark)

    def apart(member: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their components, and the groups that are in more than one."""
        here = placed(member, linked)
        split = here.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        return here, split.select("grp")

    for _ in range(1, HUB_ROUNDS):
        # Only groups in more than one component go on, with hubs that are not where the last ones are now.
        here, split = apart(member, linked)
        here = cut_lineage(narrow(here.join(split, "grp"), rows.get("member", 0)))
        if here.isEmpty():
            member = here.drop("component")
            break
        member = here.drop("component")
        still = here.select("grp").distinct()
        last = placed(hubs.join(still, "grp", "left_semi").select("grp", F.col("hub.doc").alias("doc")), linked).select(
            "grp", F.col("component").alias("hub_component"))
        hubs = cut_lineage(narrow(here.join(last, "grp").where("component <> hub_component").groupBy("grp").agg(
            F.max(F.struct("degree", "key", "doc", "size", "component")).alias("hub")), rows.get("member", 0)))
        paid = cut_lineage(narrow(placed(paid.join(still, "grp", "left_semi"), linked), rows.get("unit", 0)))
        others = paid.join(hubs, "grp").where(F.col("component") != F.col("hub.component")).select("grp", "key", "size", "doc")
        paid = paid.drop("component")
        linked = joined(linked, _links(sets, met(others, hubs), num, den))
        free_unused(spark)
    # Then what is left: groups in more than one component, under their first hubs.
    here, split = apart(member, linked)
    split = cut_lineage(narrow(split.join(first_hubs, "grp").select("grp", "family"), rows.get("member", 0)))
    if not split.isEmpty():
        columns = ["family", "doc", "key", "size", "component"]
        rest = _cross(*[cut_lineage(narrow(r.join(split, "grp").select(columns).distinct(), rows.get("member", 0)))
                        for r in (placed(paid, linked), here)], sets, num, den)
        linked = joined(linked, rest)
    sets.unpersist()
    # Rows by their class; those without words by their own id, which other rows may repeat.
    where = placed(names.select("key", "doc"), linked).select("key", "component")
    out = base.join(narrow(where, n_base), "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component"))
    if repeats is not None:
        twins = out.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("component").alias("twin"))
        out, component = out.join(narrow(twins, n_base), "doc_id", "left"), F.coalesce(component, "twin")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(component, "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, plan: Plan = PLAN, k: int = SHINGLE) -> DataFrame:
    """``docs`` (all columns) with one row of each component: that of its smallest doc_id, of rows that repeat it the one
    with the least text.  Rows without a doc_id stay.  Documents without words are in components of their own."""
    found = cut_lineage(link_components(docs, plan, k).where("doc_id is not null").select("doc_id", "component_id"))
    # What may go: all of a component but its least doc_id, and rows that repeat a doc_id.
    doubtful = (found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
                .where("doc_id <> component_id or n > 1").select("doc_id", "component_id"))
    bitmap = sieve.make(doubtful, "doc_id")
    touched, others = (sieve.sift(docs, bitmap, "doc_id", x) for x in (True, False))
    met = (touched.withColumn("doc_id", F.col("row.doc_id"))
           .join(doubtful.withColumnRenamed("component_id", "first"), "doc_id", "left"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("row.text"))
    kept = (met.where("first is null or first = doc_id").withColumn("nth", nth)
            .where("first is null or nth = 1").select("row"))
    return kept.unionAll(others).select("row.*")


def _exploded(batches: Iterator[pa.RecordBatch], k: int, prefix: bool, num: int, den: int):
    for part in chunks(batches):
        o, h, size, one, two = set_keys(utf8(part.column("text")), k)
        if prefix:
            keep = _rank_within(o) < size[o] - (-(-size[o] * num // den)) + 1
            o, h = o[keep], h[keep]
        yield pa.record_batch([_keys(one[o], two[o]), pa.array(size[o]), pa.array(h.view(np.int64))], names=["key", "size", "h"])


def _poor_pairs(docs: DataFrame, poor: DataFrame, names: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Candidate partners (a, a_key, b, b_key) of sets that lack units: a partner no larger shares one of its first elements."""
    kind = "key binary, size long, h long"
    probe = (docs.join(poor.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
             .mapInArrow(lambda b: _exploded(b, k, False, num, den), kind))
    probe = probe.join(poor.select("key").distinct(), "key", "left_semi")
    index = docs.mapInArrow(lambda b: _exploded(b, k, True, num, den), kind)
    s, t = index.alias("s"), probe.alias("t")
    hit = s.join(t, (F.col("s.h") == F.col("t.h")) & (F.col("s.key") != F.col("t.key"))
                 & (F.col("s.size") <= F.col("t.size")) & (F.col("s.size") * den >= F.col("t.size") * num))
    pairs = hit.select(F.col("s.key").alias("a_key"), F.col("t.key").alias("b_key")).distinct()
    return cut_lineage(pairs.join(names.select(F.col("key").alias("a_key"), F.col("doc").alias("a")), "a_key")
                       .join(names.select(F.col("key").alias("b_key"), F.col("doc").alias("b")), "b_key")
                       .select("a", "a_key", "b", "b_key"))
