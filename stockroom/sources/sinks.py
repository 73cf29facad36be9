"""Sinks: CSV exports (tables are written by ``store``).

The CSV export quotes every field, doubles embedded quotes, writes a header
row and ends rows with ``\\n`` -- the browser export's format.  Rows hidden by
a search are still exported, so callers pass the unsearched frame.

``write_csv`` writes a folder of files; ``export_file`` one file in the rows' order, as the browser saves it.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: export format -------------------------------------------
CSV_OPTIONS = {"header": "true", "quoteAll": "true", "quote": '"', "escape": '"', "lineSep": "\n"}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``df`` as quoted CSV files under ``path`` (one file per partition)."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row rendered as one export line (the body of the CSV file)."""
    opts = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
    return df.select(F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns]), opts)
                     .alias("line"))


def header_line(header: list[str]) -> str:
    """The header row as an export line."""
    return ",".join('"' + h.replace('"', '""') + '"' for h in header)


def export_lines(df: DataFrame, header: list[str]) -> DataFrame:
    """A whole export file as rows (line, is_header): the header row and every row of ``df``."""
    head = header_line(header)
    body = csv_lines(df).withColumn("is_header", F.lit(False))
    return df.sparkSession.createDataFrame([(head, True)], "line string, is_header boolean").unionByName(body)


def export_file(df: DataFrame, header: list[str], order: list[Column], path: str, parts: int | None = None) -> int:
    """Write one CSV file: the header once, then every row of ``df`` in ``order``; its size in bytes.

    Tasks write ranges of the order as headerless parts beside ``path``; the file system then joins them behind the header: by its
    own ``concat`` (which moves no bytes) where it has one, else by copying part after part through a small buffer.
    The file appears under its name only when it is whole.
    """
    spark = df.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    hold = f"{path}.parts"
    csv_lines(rows).write.mode("overwrite").option("lineSep", "\n").text(hold)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    names = sorted(f.getPath().getName() for f in fs.listStatus(at(hold)) if f.getLen() > 0
                   and f.getPath().getName().startswith("part-"))
    whole = at(f"{hold}/whole")
    out = fs.create(whole, True)
    out.write(bytearray((header_line(header) + "\n").encode()))
    try:
        out.close()
        found = spark.sparkContext._gateway.new_array(at, len(names))
        for i, name in enumerate(names):
            found[i] = at(f"{hold}/{name}")
        if names:
            fs.concat(whole, found)
    except PySparkException as missing:  # as the gateway gives Java's UnsupportedOperationException
        if "concat" not in str(missing).lower():
            raise
        out = fs.create(whole, True)
        out.write(bytearray((header_line(header) + "\n").encode()))
        for name in names:
            part = fs.open(at(f"{hold}/{name}"))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
        out.close()
    fs.delete(at(path), True)
    fs.rename(whole, at(path))
    fs.delete(at(hold), True)
    return fs.getFileStatus(at(path)).getLen()
