"""Levels kept up by change batches equal those counted anew, and folding reads only the batch."""

import random

from pyspark.sql import functions as F

from stockroom.operators import maintained as M
from stockroom.session import cut_lineage

STOCK, SALES = "ProductID long, QuantityAdded long", "ProductID long, QuantitySold long"


def plain(lots, sold):
    out = {}
    for at, rows in ((0, lots), (2, sold)):
        for p, q in rows:
            figures = out.setdefault(p, [0, 0, 0, 0])
            figures[at] += 1
            figures[at + 1] += q or 0
    return out


def test_folded_equals_counted_anew(spark):
    rng = random.Random(4)
    some = lambda n: [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([0, 1, 5, None])) for _ in range(n)]
    lots, sold = some(30), some(20)
    stock, sales = (lambda r: spark.createDataFrame(r, STOCK)), (lambda r: spark.createDataFrame(r, SALES))
    levels = cut_lineage(M.fold_levels(M.level_changes(stock([])), M.level_changes(stock(lots), sales_added=sales(sold))))
    for _ in range(4):
        new_lots, new_sold = some(5), some(6)
        gone = [lots.pop(rng.randrange(len(lots))) for _ in range(7)]  # deleted, or edited together with a new row
        void = [sold.pop(rng.randrange(len(sold))) for _ in range(min(len(sold), 8))]
        lots, sold = lots + new_lots, sold + new_sold
        levels = cut_lineage(M.fold_levels(levels, M.level_changes(stock(new_lots), stock(gone), sales(new_sold), sales(void))))
        assert {r.ProductID: list(r)[1:] for r in levels.collect()} == plain(lots, sold)
    every = M.level_changes(stock_removed=stock(lots), sales_removed=sales(sold))
    assert M.fold_levels(levels, every).count() == 0


def test_folding_reads_only_the_batch(spark, tmp_path):
    for name, rows, schema in (("stock", [(1, 5)], STOCK), ("new", [(1, 2)], STOCK)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    levels = cut_lineage(M.level_changes(spark.read.parquet(str(tmp_path / "stock"))))
    after = M.fold_levels(levels, M.level_changes(spark.read.parquet(str(tmp_path / "new"))))
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and str(tmp_path / "new") in plan
    products = spark.createDataFrame([(1, "a"), (2, "b")], "ProductID long, Name string")
    got = M.stock_from_levels(products, after).orderBy("ProductID").collect()
    assert [tuple(r) for r in got] == [(1, "a", 7, 0, 7), (2, "b", 0, 0, 0)]
    assert after.where(F.col("Lots") == 2).count() == 1
