"""Run registered queries on Spark and their SQL on DuckDB and compare.

Usage: ``python tests/oracle_compare.py [sf_dir] [name ...]``.
The comparison mirrors the driver's: same column names, same row count and
the same multiset of rows (order-insensitive), with value types checked.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TEST_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, decimal.Decimal):
        return "decimal"
    if isinstance(v, float):
        return "float"
    if isinstance(v, dt.datetime):
        return "ts"
    if isinstance(v, dt.date):
        return "date"
    if isinstance(v, str):
        return "str"
    return type(v).__name__


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    kinds = {}
    out = []
    for r in rows:
        out.append(tuple(_norm(r[i]) for i in order))
        for i in order:
            k = _kind(r[i])
            if k:
                kinds.setdefault(cols[i], set()).add(k)
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return [cols[i] for i in order], out, kinds


def compare(spark, sf_dir: str, name: str, con=None) -> dict:
    from stockroom.plans import REGISTRY
    from stockroom.sources import RetailTables

    q = REGISTRY[name]
    t0 = time.time()
    sdf = q.build(RetailTables.from_testdata(spark, sf_dir))
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t_spark, 2)}
    if not q.oracle:
        res["status"] = "no-oracle"
        return res
    con = con or duck(sf_dir)
    rel = con.sql(q.oracle)
    dcols = rel.columns
    drows = [tuple(r) for r in rel.fetchall()]
    res["duck_rows"] = len(drows)
    sc, sr, sk = rows_of(scols, srows)
    dc, dr, dk = rows_of(dcols, drows)
    problems = []
    if sc != dc:
        problems.append(f"columns {sc} vs {dc}")
    if len(sr) != len(dr):
        problems.append(f"rows {len(sr)} vs {len(dr)}")
    elif sr != dr:
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        problems.append(f"values differ e.g. {diff}")
    for c in sc:
        a, b = sk.get(c, set()), dk.get(c, set())
        if a and b and a != b:
            problems.append(f"type {c}: {a} vs {b}")
    res["status"] = "ok" if not problems else "FAIL"
    if problems:
        res["problems"] = problems
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    sys.path.insert(0, ".")
    from stockroom.plans import REGISTRY
    from stockroom.session import get_spark

    spark = get_spark(os.environ.get("TEST_MASTER", "local[8]"), 8)
    con = duck(sf_dir)
    bad = 0
    for name in names or list(REGISTRY):
        try:
            r = compare(spark, sf_dir, name, con)
        except Exception as exc:  # noqa: BLE001
            r = {"name": name, "status": "ERROR", "error": str(exc).splitlines()[0][:300]}
        if r["status"] not in ("ok", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv) else 0)
