"""Stored bitmaps of sold products give the sets and rankings that the sales give."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from stockroom.operators import reports as R
from stockroom.operators import sold_sets as SS
from stockroom.session import cut_lineage

SALES = "SaleDate timestamp, ProductID long, TotalAmount decimal(14,2)"
RANGES = [((1999, 1, 1), (2001, 12, 31)), ((1999, 3, 7), (2001, 2, 3)), ((1999, 2, 1), (1999, 2, 28)), ((2000, 12, 1), (2000, 12, 31)),
          ((2000, 5, 6), (2000, 5, 5)), ((1999, 11, 30), (2001, 1, 1)), ((1999, 1, 31), (1999, 2, 1))]
IDS = [0, 1, 7, 8, 9, 32767, 32768, 32769, 70000, 5_000_000_000]


def some(rng, n):
    out = []
    for _ in range(n):
        at = dt.datetime(1999, 1, 1) + dt.timedelta(days=rng.choice([30, 31, 58, 699, 700, 730, rng.randrange(1095)])) + rng.choice(
            [dt.timedelta(0), dt.timedelta(seconds=86399), dt.timedelta(seconds=86399, milliseconds=500)])
        out.append((None if rng.random() < 0.02 else at, None if rng.random() < 0.05 else rng.choice(IDS), Decimal(1)))
    return out


def same(spark, rows, sets):
    sales, ids = spark.createDataFrame(rows, SALES), spark.createDataFrame([(i,) for i in IDS], "ProductID long")
    for a, b in RANGES:
        got = ids.withColumn("Bucket", F.bitmap_bucket_number("ProductID")).join(
            SS.sold_between(sets, sales, dt.date(*a), dt.date(*b)), "Bucket").where(SS.is_in("ProductID", "Products"))
        ends = dt.datetime(*a), dt.datetime(*b) + dt.timedelta(seconds=86399)
        want = {i for at, i, _ in rows if at is not None and i is not None and ends[0] <= at <= ends[1]}
        assert {r.ProductID for r in got.collect()} == want, (a, b)


def test_sets_follow_the_sales(spark):
    rng = random.Random(3)
    rows, late = some(rng, 25), some(rng, 10)
    sets = cut_lineage(SS.sold_sets(spark.createDataFrame(rows, SALES)))
    same(spark, rows, sets)
    sets = cut_lineage(SS.fold_sold(sets, spark.createDataFrame(late, SALES)))
    rows += late
    same(spark, rows, sets)
    gone, rows = rows[::3], [r for i, r in enumerate(rows) if i % 3]
    months = sorted({r[0].date().replace(day=1) for r in gone if r[0]})
    same(spark, rows, cut_lineage(SS.rebuilt(sets, spark.createDataFrame(rows, SALES), months)))


def test_ranking_and_what_is_read(spark, tmp_path):
    rng = random.Random(5)
    spark.createDataFrame(some(rng, 60), SALES).write.parquet(str(tmp_path / "sales"))
    sales = spark.read.parquet(str(tmp_path / "sales"))
    stock = spark.createDataFrame([(rng.randrange(8), rng.choice(IDS), rng.randrange(9)) for _ in range(80)],
                                  "SupplierID long, ProductID long, QuantityAdded long")
    suppliers = spark.createDataFrame([(i, f"s{i}") for i in range(7)], "SupplierID long, Name string")
    sets = cut_lineage(SS.sold_sets(sales))
    for a, b in RANGES:
        span = dt.date(*a), dt.date(*b)
        got = SS.top_suppliers_stored(suppliers, stock, sales, sets, *span)
        assert got.collect() == R.top_suppliers(suppliers, stock, sales, *span, fanned=False).collect()
    plan = SS.sold_between(sets, sales, dt.date(1999, 2, 1), dt.date(2001, 7, 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "2001-07-01" in plan  # the last month's days; whole months are not read
    empty = SS.sold_sets(sales.limit(0))
    assert SS.top_suppliers_stored(suppliers, stock, sales.limit(0), empty, dt.date(1999, 1, 1), dt.date(2001, 7, 4)).count() == 0
