"""Stored tables that jobs can write back to safely.

A table is a folder of versions, ``<root>/<table>/v00000001``, ....  A version counts once Spark has
committed it (its ``_SUCCESS`` marker), and the highest such version is the table.

* ``replace`` writes the next version.  The version that the new rows are
  derived from is never touched, so reading and replacing one table in one job
  is safe, and a job that fails leaves the table as it was.
* ``append`` writes only the new rows, as a part of their own beside the present
  version; it counts once it is committed, so a failed append leaves no half of it.

Rows are conformed to the table: columns by name, request columns dropped, the
partition column of sales (``SaleMonth``) derived.  A missing column or another
type is refused, never cast.  Old versions are kept until ``drop_old`` is asked for.

``run_once`` applies a batch of requests so that it can be run again.  The part with the new rows holds their request ids
and its folder's name the last id given out, so rows, ids and mark are committed as one; requests that were
rejected are listed beside the table afterwards.  A request that the table or the list knows is not applied again: a batch run twice
adds nothing, and one that failed between the two steps only decides its rejected requests anew.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import MONTH_PARTITION
from ..params import DEFAULT, RunParams
from ..schema import SCHEMAS
from ..session import cut_lineage
from .retail import RetailTables

PARTITIONED = {"sales": MONTH_PARTITION}
REQUEST = "_request_id"  # of the request that a stored row comes from; no column of the table


class TableStore:
    """Versioned tables below ``root`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ---- versions -----------------------------------------------------------
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _folders(self, table: str, committed: bool = True) -> list[str]:
        """Names of the table's folders: versions ``v<n>`` and their appends ``v<n>.a<m>``."""
        fs, path = self._fs()
        at = path(f"{self.root}/{table}")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if n.startswith("v") and (
            not committed or fs.exists(path(f"{self.root}/{table}/{n}/_SUCCESS"))))

    def version(self, table: str) -> int:
        """The present version; 0 if there is none."""
        return max((int(n[1:]) for n in self._folders(table) if "." not in n), default=0)

    def _parts(self, table: str) -> list[str]:
        """The present version's folder and its committed appends."""
        now = f"v{self.version(table):08d}"
        return [f"{self.root}/{table}/{n}" for n in self._folders(table) if n == now or n.startswith(now + ".")]

    def _next(self, table: str, prefix: str) -> str:
        """A folder of the next number; numbers of failed writes are not used again."""
        used = [n[len(prefix):].split(".")[0] for n in self._folders(table, committed=False) if n.startswith(prefix)]
        return f"{self.root}/{table}/{prefix}{max(map(int, used), default=0) + 1:08d}"

    def drop_old(self, table: str) -> None:
        """Delete versions before the present one (no reader may be on them)."""
        fs, path = self._fs()
        now = self.version(table)
        for n in self._folders(table, committed=False):
            if int(n[1:].split(".")[0]) < now:
                fs.delete(path(f"{self.root}/{table}/{n}"), True)

    # ---- reading ------------------------------------------------------------
    def read(self, table: str) -> DataFrame:
        if not self.version(table):
            raise FileNotFoundError(f"no committed version of {table} under {self.root}")
        schema = StructType.fromDDL(SCHEMAS[table])
        if table in PARTITIONED:
            schema = schema.add(PARTITIONED[table], "string")
        parts = [self.spark.read.schema(schema).parquet(p) for p in self._parts(table)]
        return reduce(DataFrame.unionByName, parts)

    def tables(self, params: RunParams = DEFAULT) -> RetailTables:
        """All stored tables, each at its present version."""
        frames = {t: (lambda t=t: self.read(t)) for t in SCHEMAS if self.version(t)}
        return RetailTables(self.spark, frames, params)

    # ---- writing ------------------------------------------------------------
    def conform(self, table: str, rows: DataFrame) -> DataFrame:
        """``rows`` as the table's columns; refused if one is missing or of another type."""
        have = {f.name: f.dataType for f in rows.schema.fields}
        want = StructType.fromDDL(SCHEMAS[table]).fields
        wrong = [f"{f.name} is {have[f.name].simpleString() if f.name in have else 'missing'}, "
                 f"not {f.dataType.simpleString()}" for f in want if have.get(f.name) != f.dataType]
        if wrong:
            raise ValueError(f"rows don't fit table {table}: {'; '.join(wrong)}")
        out = rows.select(*[f.name for f in want])
        part = PARTITIONED.get(table)
        return out.withColumn(part, F.date_format("SaleDate", "yyyy-MM")) if part else out

    def _write(self, table: str, rows: DataFrame, path: str) -> None:
        out = self.conform(table, rows)
        if REQUEST in rows.columns:
            out = rows.select(REQUEST, *[F.col(c) for c in rows.columns if c in out.columns])
            if table in PARTITIONED:
                out = out.withColumn(PARTITIONED[table], F.date_format("SaleDate", "yyyy-MM"))
        writer = out.write.mode("errorifexists")
        if table in PARTITIONED:
            writer = writer.partitionBy(PARTITIONED[table])
        writer.parquet(path)

    def compact(self, table: str) -> None:
        """Make a table and its appends one version, when many appends have made reading slow."""
        self.replace(table, self.read(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Make ``rows`` the table; they may be derived from its present version."""
        self._write(table, rows, self._next(table, "v"))

    def append(self, table: str, rows: DataFrame) -> None:
        """Add ``rows`` to the table."""
        now = self.version(table)
        if not now:
            return self.replace(table, rows)
        self._write(table, rows, self._next(table, f"v{now:08d}.a"))

    # ---- batches that may be run again ---------------------------------------
    def decided(self, table: str) -> DataFrame:
        """(request_id): the requests that ``run_once`` has accepted or rejected for a table."""
        fs, path = self._fs()
        listed = f"{self.root}/{table}.decided"
        out = self.spark.createDataFrame([], "request_id long")
        if fs.exists(path(listed)):
            out = out.unionAll(self.spark.read.schema("request_id long").parquet(listed))
        for p in self._parts(table)[1:]:
            out = out.unionAll(self.spark.read.schema(f"{REQUEST} long").parquet(p).where(f"{REQUEST} is not null").select(REQUEST))
        return out

    def last_id(self, table: str, id_column: str) -> int:
        """The highest id given out: from the names of the appended parts; only a table without such parts is read for it."""
        marks = [int(p.rsplit(".m", 1)[1]) for p in self._parts(table)[1:] if ".m" in p.rsplit("/", 1)[1]]
        if marks:
            return max(marks)
        return self.read(table).agg(F.max(id_column)).first()[0] or 0

    def run_once(self, table: str, id_column: str, requests: DataFrame,
                 job: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]]) -> int:
        """Apply the requests not decided before; the number of new rows.

        ``job`` turns them and the last id given out into (new rows with request_id, numbered on from there; rejected
        requests with request_id).  Rows from elsewhere must not be appended to the table with ids of their own in between.
        """
        last = self.last_id(table, id_column)
        fresh = cut_lineage(requests.join(self.decided(table), "request_id", "left_anti"))
        rows, rejects = job(fresh, last)
        rows = cut_lineage(rows.withColumn(REQUEST, F.col("request_id").cast("long")).drop("request_id"))
        n = rows.count()
        if n:
            self._write(table, rows, self._next(table, f"v{self.version(table):08d}.a") + f".m{last + n}")
        rejects.select(F.col("request_id").cast("long")).write.mode("append").parquet(f"{self.root}/{table}.decided")
        return n
