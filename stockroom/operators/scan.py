"""Ordered scans that stay parallel when one key holds a large share of the rows.

A plain ``sum(...).over(Window.partitionBy(key).orderBy(...))`` sends every row
of a key to one task.  ``running_sums`` instead splits the ordered rows into
range chunks (``repartitionByRange`` samples the key+order columns, so a hot
key spans several chunks), sums each (key, chunk), turns the chunk sums into
offsets, and adds each row's in-chunk running sum to its chunk offset.  The
chunk assignment is checkpointed so that a recomputation after a lost executor
sees the same chunks.  There is one way for every size of input.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = "_chunk"


def _chunks(df: DataFrame) -> int:
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(n, 1)


def range_chunked(df: DataFrame, keys: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """``df`` range-partitioned on (keys, order) with the chunk number attached, checkpointed."""
    n = n or _chunks(df)
    parted = df.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return cut_lineage(parted)


def _offsets(per_chunk: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """For each (key, chunk), the sums of the key's earlier chunks."""
    if keys:
        before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        return per_chunk.select(*keys, CHUNK, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums])
    # Without keys there is one row for each chunk: the driver adds them up.
    rows = sorted(per_chunk.collect(), key=lambda r: r[CHUNK])
    totals = {c: [0, *accumulate(r[c] or 0 for r in rows)] for c in sums}
    data = [(r[CHUNK], *(totals[c][i] for c in sums)) for i, r in enumerate(rows)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in per_chunk.select(CHUNK, *sums).schema)
    return F.broadcast(per_chunk.sparkSession.createDataFrame(data, schema))


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column],
                 inclusive: bool = True, n: int | None = None) -> DataFrame:
    """Add running sums per key in ``order`` for each ``name -> value`` in ``values``.

    ``inclusive=False`` gives the sum of the strictly earlier rows.  ``order``
    must be a total order within a key.  NULL keys form their own group.
    """
    base = range_chunked(df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()]), keys, order, n)
    per_chunk = base.groupBy(*keys, CHUNK).agg(*[F.sum(f"_v_{k}").alias(f"_c_{k}") for k in values])
    offsets = _offsets(per_chunk, keys, [f"_c_{k}" for k in values])
    offsets = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CHUNK).alias("_k_chunk"),
                             *[F.col(f"_c_{k}").alias(f"_o_{k}") for k in values])
    frame = (Window.partitionBy(*keys, CHUNK).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = base.select("*", *[F.coalesce(F.sum(f"_v_{k}").over(frame), F.lit(0)).alias(f"_l_{k}")
                               for k in values])
    cond = [local[k].eqNullSafe(offsets[f"_k_{k}"]) for k in keys] + [local[CHUNK] == offsets["_k_chunk"]]
    out = local.join(offsets, cond)
    return out.select(*[local[c] for c in df.columns],
                      *[(F.col(f"_o_{k}") + F.col(f"_l_{k}")).alias(k) for k in values])


def number_rows(df: DataFrame, order: list[str], out: str, base: Column | int = 0,
                n: int | None = None) -> DataFrame:
    """Number rows 1..N in ``order`` (plus ``base``) without a single-task global window.

    This is ``running_sums`` with no key: each range chunk is numbered locally
    and shifted by the row count of the chunks before it.
    """
    numbered = running_sums(df, [], order, {out: F.lit(1).cast("long")}, inclusive=True, n=n)
    base_col = base if isinstance(base, Column) else F.lit(base)
    return numbered.withColumn(out, F.col(out) + base_col)
