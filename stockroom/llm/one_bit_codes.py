"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is scaled to unit length and turned by one fixed random rotation;
its code is the signs, packed into bits.  With a = <code / sqrt(D), vector>
as its correction scalar, <code / sqrt(D), query> / a estimates the cosine, and the error stays below
``bound * sqrt((1 - a^2) / a^2 / (D - 1))`` but for a share of about
exp(-bound^2 / 2) of the estimates.

Vectors stand in blocks, and so do the queries (a stated share of the ids); each
block of vectors meets each block of queries once, as one pair of rows with a key of
its own.  In a pair, every query takes its best estimates, ranks them exactly,
and then ranks exactly all others whose estimate plus error bound could
still be among the ``k`` best.  The best of all pairs are kept by rank.
The index holds every row; nothing is sampled and no bucket is capped.

Cosines are in double precision on the original vectors, their sums taken in
the order of the components.  Vectors that are null, zero, or hold null or
non-finite components take no part, nor do rows without an id; of rows that
repeat an id the least vector counts.  Only vectors of one length are
compared.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage

ERROR_BOUND = 3.0
VECTORS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048
# Groups of vector blocks that meet the queries' block numbers apart from each other.
VECTOR_SHARES = 256
SEED = 97

_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if (dim, seed) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
        _ROTATIONS[dim, seed] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, seed]


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction scalars) of unit vectors."""
    x = unit @ turn.T
    return np.packbits(x >= 0, axis=1), np.abs(x).sum(axis=1) / np.sqrt(x.shape[1])


def estimate(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosines, standard errors of each code) of packed codes and rotated unit queries."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    value = (signs @ queries.T.astype(np.float32)) / (np.sqrt(dim) * scalars[:, None]).astype(np.float32)
    error = np.sqrt(np.maximum(1 - scalars**2, 0) / scalars**2 / max(dim - 1, 1))
    return value, error


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; sums run over the components in their order."""
    if not len(vectors):
        return np.zeros(0)
    dot = np.cumsum(vectors * query, axis=1)[:, -1]
    own = np.sqrt(np.cumsum(vectors * vectors, axis=1)[:, -1])
    return dot / (np.sqrt(np.cumsum(query * query)[-1]) * own)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (dim, n, ids, vectors, codes, scalars) of up to ``size`` vectors each."""
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

    def row(dim: int) -> pa.RecordBatch:
        ids, vectors = held.pop(dim)
        x = np.array(vectors)
        codes, scalars = encode(x / np.sqrt((x * x).sum(axis=1))[:, None], rotation(dim))
        return pa.record_batch([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), *(
            pa.array([v.tobytes()], pa.binary()) for v in (np.array(ids, "<i8"), x, codes, scalars))],
            names=["dim", "n", "ids", "vectors", "codes", "scalars"])

    for batch in batches:
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", under="ignore"):
                norm = (x * x).sum() if len(x) else 0.0
            if not (np.isfinite(x).all() and 0 < norm < np.inf):
                continue
            ids, vectors = held.setdefault(len(x), ([], []))
            ids.append(i)
            vectors.append(x)
            if len(ids) == size:
                yield row(len(x))
    for dim in list(held):
        yield row(dim)


_BLOCK = "dim int, n int, ids binary, vectors binary, codes binary, scalars binary"


def _search(batches: Iterator[pa.RecordBatch], k: int, bound: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            dim = r["dim"]
            ids = np.frombuffer(r["ids"], "<i8")
            x = np.frombuffer(r["vectors"], "<f8").reshape(-1, dim)
            codes = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
            q_ids = np.frombuffer(r["q_ids"], "<i8")
            q = np.frombuffer(r["q_vectors"], "<f8").reshape(-1, dim)
            turned = (q / np.sqrt((q * q).sum(axis=1))[:, None]) @ rotation(dim).T
            out: list[tuple[int, int, float]] = []
            for lo in range(0, len(q), 256):
                value, error = estimate(codes, np.frombuffer(r["scalars"], "<f8"), turned[lo:lo + 256])
                upper = value + (bound * error)[:, None].astype(np.float32) + np.float32(1e-5)
                upper[:, :][ids[:, None] == q_ids[None, lo:lo + 256]] = -np.inf
                for j in range(value.shape[1]):
                    top = min(4 * k + 1, len(ids))
                    first = np.argpartition(-upper[:, j], top - 1)[:top]
                    first = first[ids[first] != q_ids[lo + j]]
                    score = cosines(x[first], q[lo + j])
                    least = np.sort(score)[-k] if len(score) >= k else -np.inf
                    if least > -np.inf:
                        some = np.flatnonzero(upper[:, j] >= least)
                    else:
                        some = np.flatnonzero(ids != q_ids[lo + j])
                    score = cosines(x[some], q[lo + j])
                    best = np.lexsort((ids[some], -score))[:k]
                    out += [(int(q_ids[lo + j]), int(ids[some[b]]), float(score[b])) for b in best]
            if out:
                a, b, c = zip(*out)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())],
                                      names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query, k: int = 5, bound: float = ERROR_BOUND) -> DataFrame:
    """The ``k`` nearest of each query: (query_id, rank from 1, vec_id, score).

    ``vectors`` has vec_id and embedding (other columns are not read); ``is_query`` is a condition
    on vec_id.  A query's own id is no candidate.
    """
    rows = (vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
            .where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null)")
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    # Numbers follow the checkpointed rows, so a task that runs again deals the same pairs.
    found = cut_lineage(rows.mapInArrow(lambda b: _blocks(b, VECTORS_PER_BLOCK), _BLOCK)
                        .withColumn("block", F.monotonically_increasing_id()))
    asked = cut_lineage(rows.where(is_query).coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, 1))
                        .mapInArrow(lambda b: _blocks(b, QUERIES_PER_BLOCK), _BLOCK)
                        .withColumn("block", F.monotonically_increasing_id()))
    # Pairs of block numbers are dealt by the vectors' share, so that no task makes all pairs of a length.
    shares = VECTOR_SHARES
    v = found.select("dim", F.col("block").alias("vb"), F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("share"))
    q = asked.select("dim", F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    pairs = v.join(q, ["dim", "share"]).drop("share")
    # The last join deals by blocks of vectors, of which there are many more than blocks of queries.
    pairs = (pairs.join(asked.select(F.col("block").alias("qb"), F.col("ids").alias("q_ids"),
                                     F.col("vectors").alias("q_vectors")), "qb")
             .join(found.drop("dim").withColumnRenamed("block", "vb"), "vb"))
    best = pairs.mapInArrow(lambda b: _search(b, k, bound), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
