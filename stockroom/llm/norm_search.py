"""Exact top-k inner products by descending length, with SVD-rotated partial sums.

Every component x becomes the whole number floor(1024 * x); scores are exact integer inner products.

1. The right singular vectors of all vectors (eigenvectors of their summed products) give a rotation that gathers most of every vector's
   length in its first coordinates.  Inner products don't change under it.
2. Vectors are dealt by ranges of descending length and stand in blocks of bounded size.
3. The block of the longest vectors is met by all queries first; each query's k-th best score there is its floor.
4. Queries are dealt into blocks by floor / own length, the length that a vector needs at least.  A block of vectors
   meets only blocks of queries that its longest vector could serve (Cauchy-Schwarz); the others are never paired.
5. In a pair, vectors are taken by descending length in slices.  A slice ends the pair for queries whose floor is
   above own length * slice's length; then the partial sums over the first rotated coordinates
   plus the product of the residual lengths bound each score, and only what may reach the floor is summed exactly.
   Floors rise as better vectors are found.
6. The best of all pairs are kept by rank.

Bounds are widened by a rounding allowance, so nothing that ties with the floor is lost.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do vectors longer than 2**31 in the
scaled numbers, whose products may not fit 64 bits, nor rows without an id.  Of rows that repeat an id the least vector
counts.  Only vectors of equally many components are compared.  A query's own id is no candidate.
Ties go to the smaller id; with fewer than k candidates all are returned; an empty table gives no rows.  Columns besides vec_id
and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import shuffle_partitions
from .matrices import matrix_sums, stacked

SCALE = 1024
# Bytes of the components of one block, as 64-bit numbers.
VECTOR_BLOCK, QUERY_BLOCK = 2 << 20, 1 << 19
# Vectors of a slice, and queries that meet it at once.
SLICE, QUERIES_AT_ONCE = 512, 512
# Share of the rotated coordinates in the partial sums.
HEADS = (0.25, 0.5)
# Squared length up to which inner products fit a long.
LONGEST = 2.0**62
_BLOCK = "dim int, low double, top double, ids binary, vectors binary, floors binary"
_FOUND = "query_id long, vec_id long, score long"


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim, length2): the usable vectors in scaled whole numbers, one for each id, with their squared lengths."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= 2.0**31))
    rows = (vectors.select(F.col("vec_id").cast("long"), x.alias("embedding"))
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
            .select("vec_id", F.transform("embedding", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))
    length2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), length2.alias("length2")).where(
        F.col("length2") <= LONGEST * (1 - 1e-9))


def _products(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """Summed outer products of a task's vectors, by vector length."""
    out: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in stacked(batch.column("v")):
            out[x.shape[1]] = out.get(x.shape[1], 0) + x.T @ x
    return {dim: m.ravel() for dim, m in out.items()}


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """{vector length: rotation}: rows are the right singular vectors of all vectors, by falling singular value."""
    sums = matrix_sums(rows.select("v"), _products)
    return {dim: np.ascontiguousarray(np.linalg.eigh(m.reshape(dim, dim))[1][:, ::-1].T) for dim, m in sums.items()}


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``limit`` bytes of vectors, in the order they come, with the least and greatest ``rank_by``."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def rows(dim: int, whole: bool) -> Iterator[pa.RecordBatch]:
        ids, x, floor, by = (np.concatenate(c) for c in zip(*held.pop(dim)))
        most = max(limit // (8 * dim), 1)
        cut = len(ids) if whole else len(ids) // most * most
        for a in range(0, cut, most):
            b = min(a + most, cut)
            yield pa.record_batch([
                pa.array([dim], pa.int32()), pa.array([by[a:b].min()]), pa.array([by[a:b].max()]),
                *(pa.array([c[a:b].tobytes()], pa.binary()) for c in (ids, x, floor))],
                names=["dim", "low", "top", "ids", "vectors", "floors"])
        if cut < len(ids):
            held[dim] = [(ids[cut:], x[cut:], floor[cut:], by[cut:])]

    for batch in batches:
        ids, floor, by = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "floor", "rank_by"))
        for at, x in stacked(batch.column("v"), np.int64):
            dim = x.shape[1]
            held.setdefault(dim, []).append((ids[at], x, floor[at], by[at]))
            if sum(len(i) for i, *_ in held[dim]) * 8 * dim >= limit:
                yield from rows(dim, False)
    for dim in list(held):
        yield from rows(dim, True)


def in_blocks(rows: DataFrame, order: Column, limit: int, total: int) -> DataFrame:
    """Checkpointed blocks of ``rows`` (vec_id, v, dim, floor, rank_by), dealt by ranges of (dim, order, vec_id)."""
    parts = max(1, min(shuffle_partitions(rows.sparkSession), -(-total // limit)))
    dealt = rows.repartitionByRange(parts, F.col("dim"), order, F.col("vec_id")).sortWithinPartitions(
        F.col("dim"), order, F.col("vec_id"))
    return cut_lineage(dealt.select("vec_id", "v", "floor", "rank_by").mapInArrow(lambda b: _blocks(b, limit), _BLOCK)
                       .withColumn("block", F.monotonically_increasing_id()))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, modulo 2**64, which is exact as all of them fit."""
    out = np.empty(len(a), dtype=np.int64)
    for lo in range(0, len(a), 1 << 14):
        out[lo:lo + (1 << 14)] = (a[lo:lo + (1 << 14)] * b[lo:lo + (1 << 14)]).sum(axis=1)
    return out


def _keep_best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best, by query and rank."""
    order = np.lexsort((ids, -score, q))
    at = np.flatnonzero(np.diff(q[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
    return order[rank < k]


def search_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, turn: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vector id, score) of each query's ``k`` best vectors that reach its floor ``least``.

    ``x`` is sorted by descending length; a floor is a float, -inf if none.
    """
    dim = x.shape[1]
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    x_turned, q_turned = xf @ turn.T, qf @ turn.T
    x_len, q_len = np.sqrt((xf * xf).sum(axis=1)), np.sqrt((qf * qf).sum(axis=1))
    heads = sorted({max(int(dim * share), 1) for share in HEADS} - {dim})
    x_rest, q_rest = ([np.sqrt((t[:, h:] ** 2).sum(axis=1)) for h in heads] for t in (x_turned, q_turned))
    floor = least.copy()
    empty = np.zeros(0, dtype=np.int64)
    best = (empty, empty, empty)
    for a in range(0, len(x), SLICE):
        part = slice(a, min(a + SLICE, len(x)))
        slack = 1e-9 * x_len[a] * q_len + 1e-6
        live = np.flatnonzero(x_len[a] * q_len + slack >= floor)
        if not len(live):
            break
        hit_v, hit_q = [], []
        for b in range(0, len(live), QUERIES_AT_ONCE):
            some = live[b:b + QUERIES_AT_ONCE]
            bar = (floor - slack)[some]
            v, s = None, None
            done = 0
            for step, h in enumerate(heads):
                if v is None:  # all pairs at once
                    sums = x_turned[part, :h] @ q_turned[some, :h].T
                    v, s = np.nonzero(sums + x_rest[step][part, None] * q_rest[step][None, some] >= bar[None, :])
                    sums = sums[v, s]
                else:  # the pairs left
                    sums += np.einsum("ij,ij->i", x_turned[a + v, done:h], q_turned[some[s], done:h])
                    ok = sums + x_rest[step][a + v] * q_rest[step][some[s]] >= bar[s]
                    v, s, sums = v[ok], s[ok], sums[ok]
                done = h
            if v is None:
                v, s = (g.ravel() for g in np.indices((part.stop - a, len(some))))
            hit_v.append(a + v)
            hit_q.append(some[s])
        v, s = np.concatenate(hit_v), np.concatenate(hit_q)
        other = ids[v] != q_ids[s]
        v, s = v[other], s[other]
        score = _exact(x[v], q[s])
        ok = score >= floor[s] - slack[s]
        v, s, score = v[ok], s[ok], score[ok]
        if len(v):
            best = tuple(np.concatenate(c) for c in zip(best, (s, ids[v], score)))
            keep = _keep_best(*best, k)
            best = tuple(c[keep] for c in best)
            count = np.bincount(best[0], minlength=len(q))
            last = np.cumsum(count) - 1
            full = np.flatnonzero(count >= k)
            floor[full] = np.maximum(floor[full], best[2][last[full]].astype(np.float64))
    return best


def _search(batches: Iterator[pa.RecordBatch], turns: dict[int, np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            dim = r["dim"]
            ids, q_ids = (np.frombuffer(r[c], "<i8") for c in ("ids", "q_ids"))
            x, q = (np.frombuffer(r[c], "<i8").reshape(-1, dim) for c in ("vectors", "q_vectors"))
            s, v, score = search_block(ids, x, q_ids, q, np.frombuffer(r["floors"], "<f8"), turns[dim], k)
            if len(s):
                yield pa.record_batch([pa.array(q_ids[s]), pa.array(v), pa.array(score)],
                                      names=["query_id", "vec_id", "score"])


def _dealt(blocks: DataFrame, queries: DataFrame, copies: int) -> DataFrame:
    """Rows of blocks beside rows of queries of the same vector length: blocks are copied, so that no key holds all pairs."""
    spread = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return queries.withColumn("salt", F.pmod(F.xxhash64("q_block"), F.lit(copies)).cast("int")).join(
        spread, ["dim", "salt"]).drop("salt")


def top_products(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The ``k`` highest inner products of each query: (query_id, rank from 1, vec_id, score long).

    ``is_query`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(scaled(vectors)).withColumn("length", F.sqrt("length2"))
    turns = spark.sparkContext.broadcast(rotations(rows))
    size = F.coalesce(F.sum(F.col("dim") * 8), F.lit(0))
    total, total_asked = rows.agg(size, F.coalesce(F.sum(F.when(is_query, F.col("dim") * 8)), F.lit(0))).first()
    copies = max(1, min(shuffle_partitions(spark), -(-total_asked // QUERY_BLOCK)))
    none = F.lit(float("-inf"))
    blocks = in_blocks(rows.withColumn("rank_by", F.col("length")).withColumn("floor", none), F.desc("rank_by"),
                       VECTOR_BLOCK, total).drop("floors", "low")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def asked(rows: DataFrame, by: Column) -> DataFrame:
        told = in_blocks(rows.withColumn("rank_by", by), F.asc("rank_by"), QUERY_BLOCK, total_asked)
        return told.withColumnsRenamed({"block": "q_block", "ids": "q_ids", "vectors": "q_vectors"}).drop("top")

    # The block of the longest vectors of each vector length meets all queries.
    first = blocks.groupBy("dim").agg(F.min("block").alias("block"))
    longest = blocks.join(first.select("block"), "block").select("dim", "ids", "vectors")
    queries = rows.where(is_query)
    met = _dealt(longest, asked(queries.withColumn("floor", none), F.col("length")), copies)
    seeds = cut_lineage(best(met.mapInArrow(lambda b: _search(b, turns.value, k), _FOUND)).drop("rank"))
    floors = seeds.groupBy(F.col("query_id").alias("vec_id")).agg(
        F.when(F.count("*") == k, F.min("score").cast("double")).alias("floor"))
    queries = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
    # Queries again in blocks, now by the length that a vector needs at least.
    need = F.when(F.col("floor") > 0, F.col("floor") / F.col("length")).otherwise(0.0)
    told = asked(queries, need)
    others = blocks.join(first.select("block"), "block", "left_anti")
    # The rounding of lengths gets some slack.
    pairs = _dealt(others.select("dim", "block", "top"), told.select("dim", "q_block", "low"), copies).where(
        F.col("top") * (1 + 1e-9) + 1e-6 >= F.col("low")).select("q_block", "block")
    met = pairs.join(told.select("q_block", "q_ids", "q_vectors", "floors"), "q_block").join(
        others.select("block", "dim", "ids", "vectors"), "block")
    found = met.mapInArrow(lambda b: _search(b, turns.value, k), _FOUND)
    return best(seeds.unionAll(found)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
