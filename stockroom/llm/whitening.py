"""Whitening of vectors by the covariance of their distinct values, weighted by multiplicity.

Every entry c becomes the whole number x = floor(1024 * c) + 100000.

1. Identical vectors of an Arrow batch are joined into one row with their ids at once, so a vector that a third of
   the rows hold travels once for each batch.  Grouping these rows gives the distinct vectors and their multiplicity.
2. The fit weighs each distinct vector by its count (or by one, ``weights="one"``).  The sums of weights and of every
   dimension are exact whole numbers.
3. The covariance is a weighted matrix product of the centred distinct vectors, divided by the sum of weights.  Tasks give partial
   products, two grouped steps add them; the driver gets one matrix and solves for its unit eigenvectors.
4. Each distinct vector is whitened once, with its exact squared deviation, and joined back to the rows of ids.  Vectors with more than
   a task's share of those rows are fewer than there are tasks: their hashes are broadcast, their rows are salted.
5. The covariance of what came out, weighted alike, is measured against the identity.

Rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do those with an entry
beyond 2**53 / 1024, which has no exact x.  Rows that repeat an id are rows of their own, a null id stays null.  Vectors
of each length are a fit of their own.  Components whose eigenvalue is under 1e-11 of the trace are rounding, cannot be whitened and are
left out: a table of identical vectors (or one row) gives no rows, as does an empty table.  Equal eigenvalues keep
the order and directions that the solver gives.  Columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import shuffle_partitions
from .matrices import matrix_sums, stacked

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Vectors that are grouped at once, which bounds the ids of a row.
GROUPED_AT_ONCE = 1 << 13
LEAST_SHARE = 1e-11


@dataclass(frozen=True)
class Fit:
    """What is learned from all vectors of one length."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray  # one row for each component
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, ids, count) of identical vectors among those that come together."""
    for batch in batches:
        ids = batch.column("vec_id")
        for at, x in stacked(batch.column("x"), np.int64):
            for lo in range(0, len(at), GROUPED_AT_ONCE):
                part, here = np.ascontiguousarray(x[lo:lo + GROUPED_AT_ONCE]), at[lo:lo + GROUPED_AT_ONCE]
                whole = part.view(np.dtype((np.void, part.shape[1] * 8))).ravel()
                _, first, group = np.unique(whole, return_index=True, return_inverse=True)
                order = np.argsort(group, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(group))])
                flat = pa.array(part[first].ravel())
                steps = np.arange(len(first) + 1) * part.shape[1]
                yield pa.record_batch([
                    pa.ListArray.from_arrays(pa.array(steps, pa.int32()), flat),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(here[order]))),
                    pa.array(np.diff(ends), pa.int64())], names=["x", "ids", "count"])


def shifted(vectors: DataFrame) -> DataFrame:
    """(x, ids, count): the usable vectors in whole numbers, identical ones that come together joined."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= 2.0**43))
    rows = (vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
            .where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
            .select("vec_id", F.transform("embedding", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x")))
    return rows.mapInArrow(_together, "x array<long>, ids array<long>, count long")


def _weighted_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, place, total): a task's exact weighted sums of each dimension; place -1 is the sum of weights."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        weight = batch.column("weight").to_numpy()
        for at, x in stacked(batch.column("x"), np.int64):
            w = weight[at]
            small = float(np.abs(x).max()) * float(w.sum()) < 2.0**62
            sums = (x * w[:, None]).sum(axis=0) if small else (x.astype(object) * w[:, None].astype(object)).sum(axis=0)
            held[x.shape[1]] = held.get(x.shape[1], 0) + np.array([int(w.sum()), *sums.tolist()], dtype=object)
    for dim, sums in held.items():
        yield pa.record_batch([pa.array([dim] * (dim + 1), pa.int32()), pa.array(range(-1, dim), pa.int32()),
                               pa.array(sums.tolist(), pa.decimal128(38, 0))], names=["dim", "place", "total"])


def exact_sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{vector length: (n, sums of the dimensions)}: as many numbers as vectors have entries reach the driver."""
    rows = distinct.mapInArrow(_weighted_sums, "dim int, place int, total decimal(38,0)")
    out: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("dim", "place").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r["dim"], {})[r["place"]] = int(r["total"])
    return {dim: (v[-1], [v[j] for j in range(dim)]) for dim, v in out.items()}


def _covariance_of(what: Callable[[int, np.ndarray], np.ndarray | None], column: str) -> Callable:
    """Partial sums of weighted outer products of ``what(dim, vectors)``."""
    def each(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for at, x in stacked(batch.column(column)):
                y = what(x.shape[1], x)
                out[x.shape[1]] = out.get(x.shape[1], 0) + y.T @ (y * weight[at][:, None])
        return {dim: m.ravel() for dim, m in out.items()}
    return each


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each vector length of ``distinct`` (x, weight)."""
    sums = exact_sums(distinct)
    means = {dim: Fit(n, tuple(s), np.zeros((0, dim)), np.zeros(0), 0.0).mean for dim, (n, s) in sums.items()}
    sent = distinct.sparkSession.sparkContext.broadcast(means)
    products = matrix_sums(distinct, _covariance_of(lambda dim, x: x - sent.value[dim], "x"))
    out = {}
    for dim, (n, s) in sums.items():
        v = products[dim].reshape(dim, dim) / n
        value, vector = np.linalg.eigh((v + v.T) / 2)
        value, vector, trace = value[::-1], vector[:, ::-1], float(np.trace(v))
        real = int((value[:components] > LEAST_SHARE * trace).sum()) if trace > 0 else 0
        out[dim] = Fit(n, tuple(s), np.ascontiguousarray(vector[:, :real].T), value[:real], trace)
    return out


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """The exact sums over dimensions of (n * x - sum)^2."""
    far = max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, sums))
    if far < 2**62:
        d = x * np.int64(n) - np.array(sums, dtype=np.int64)
        if float(np.abs(d).max()) ** 2 * x.shape[1] < 2.0**62:
            return (d * d).sum(axis=1).tolist()
        d = d.astype(object)
    else:
        d = x.astype(object) * n - np.array(sums, dtype=object)
    return (d * d).sum(axis=1).tolist()


def _whitened(batches: Iterator[pa.RecordBatch], fits: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, x in stacked(batch.column("x"), np.int64):
            f = fits.value[x.shape[1]]
            y = (x - f.mean) @ f.directions.T / np.sqrt(f.eigenvalues)
            whole = batch.take(pa.array(at))
            steps = np.arange(len(at) + 1) * y.shape[1]
            yield pa.record_batch([whole.column("key"), whole.column("weight"),
                                   pa.array(np.full(len(at), x.shape[1]), pa.int32()),
                                   pa.array([str(d) for d in deviations(x, f.n, f.sums)], pa.string()),
                                   pa.ListArray.from_arrays(pa.array(steps, pa.int32()), pa.array(y.ravel()))],
                                  names=["key", "weight", "dim", "deviation", "whitened"])


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "count") -> tuple[DataFrame, dict[int, Fit], dict[int, float]]:
    """(rows, fits, identity errors), the latter two by vector length.

    Rows are (vec_id, dim, deviation, whitened) of every usable row of ``vectors`` (vec_id, embedding): the exact
    squared deviation as a decimal string, which has no upper bound, and as many whitened numbers as its fit has components.
    ``weights`` is "count" (each row counts) or "one" (each distinct vector does).
    """
    if weights not in ("count", "one"):
        raise ValueError(f"weights are 'count' or 'one', not {weights!r}")
    spark = vectors.sparkSession
    # The 128-bit name of a vector stands for it in the join.
    text = F.array_join("x", ",")
    rows = cut_lineage(shifted(vectors).withColumn("key", F.unhex(F.md5(text))))
    distinct = cut_lineage(rows.groupBy("key").agg(F.first("x").alias("x"), F.sum("count").alias("count"), F.count("*").alias("parts"))
                           .withColumn("weight", F.col("count") if weights == "count" else F.lit(1).cast("long")))
    fits = fit(distinct.select("x", "weight"), components)
    sent = spark.sparkContext.broadcast(fits)
    done = cut_lineage(distinct.select("key", "x", "weight").mapInArrow(
        lambda b: _whitened(b, sent), "key binary, weight long, dim int, deviation string, whitened array<double>"))
    errors = {}
    for dim, m in _whitened_covariances(done, fits).items():
        size = len(fits[dim].eigenvalues)
        errors[dim] = float(np.abs(m.reshape(size, size) - np.eye(size)).max())
    return _back(rows, distinct, done).select("vec_id", "dim", "deviation", "whitened"), fits, errors


def _whitened_covariances(done: DataFrame, fits: dict[int, Fit]) -> dict[int, np.ndarray]:
    """Covariances, centred, of the whitened numbers by vector length."""
    out = {}
    for dim, f in fits.items():
        size = len(f.eigenvalues)
        if not size:
            continue
        here = done.where(F.col("dim") == dim).select("whitened", "weight")
        means = matrix_sums(here, _sum_of_rows)[size] / f.n
        out[dim] = matrix_sums(here, _covariance_of(lambda _, y, m=means: y - m, "whitened"))[size] / f.n
    return out


def _sum_of_rows(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for batch in batches:
        weight = batch.column("weight").to_numpy()
        for at, y in stacked(batch.column("whitened")):
            out[y.shape[1]] = out.get(y.shape[1], 0) + (y * weight[at][:, None]).sum(axis=0)
    return out


def _back(rows: DataFrame, distinct: DataFrame, done: DataFrame) -> DataFrame:
    """The rows of ids with what their vector became, one row for each id."""
    spark = rows.sparkSession
    tasks = shuffle_partitions(spark)
    # Fewer vectors than tasks have more than a task's share of the rows.
    share = (distinct.agg(F.sum("parts")).first()[0] or 0) / tasks
    hot = [bytes(r["key"]) for r in distinct.where(F.col("parts") > max(share, 1)).select("key").collect()]
    salted = F.col("key").isin(hot) if hot else F.lit(False)
    left = rows.select("key", "ids").withColumn(
        "salt", F.when(salted, F.pmod(F.xxhash64("ids"), F.lit(tasks)).cast("int")).otherwise(0))
    right = done.drop("weight").withColumn(
        "salt", F.explode(F.when(salted, F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, ["key", "salt"]).select(F.explode("ids").alias("vec_id"), "dim", "deviation", "whitened")
