"""Connected components of a link table, as rounds of joins and grouped minima.

Each round points every node's larger neighbours, then its smaller ones, at
the least node it knows, until nothing changes.  Each round is checkpointed in the
shared folder, so lost executors don't undo rounds, and no component is ever
gathered in one place.  The table of least neighbours is dealt anew for the joins, so that Spark can split the
rows of a hub over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import shuffle_partitions

# Links of one partition: few links make few and larger files of every shuffle.
LINKS_PER_PART = 1 << 16


def _toward_least(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """``large``: neighbours above each node go to the least node near it; else those below and itself."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts)
    out = both.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").coalesce(parts)


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v longs); component is the least node reachable.

    Self links and repeats are allowed; nulls are not links.  ``rows``: about how many links there are, if known.
    """
    most = shuffle_partitions(links.sparkSession)
    parts = most if rows is None else max(1, min(most, -(-rows // LINKS_PER_PART)))
    edges = cut_lineage(links.select(F.col("u").cast("long"), F.col("v").cast("long"))
                        .where("u <> v").distinct().coalesce(parts))
    while not _are_stars(edges):
        edges = cut_lineage(_toward_least(_toward_least(edges, True, parts), False, parts).distinct().coalesce(parts))
    least = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(least)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points at one smaller node that points at none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), (F.col("u") < F.col("v")).cast("int").alias("bad")
                        ).union(edges.select("v", F.lit(0), F.lit(0))).withColumn("into", 1 - F.col("out"))
    return (ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"), F.max("bad").alias("bad"))
            .where("out > 1 or bad = 1 or (out = 1 and into = 1)").isEmpty())
