"""Figures from stored sums equal those of the sales, after late, deleted and edited sales too."""

import datetime as dt
import random
from decimal import Decimal

from stockroom.operators import range_sums as RS
from stockroom.operators import reports as R
from stockroom.session import cut_lineage

SALES = "SaleDate timestamp, TotalAmount decimal(14,2), QuantitySold long"
RANGES = [((1999, 1, 1), (2001, 12, 31)), ((1999, 3, 7), (2001, 2, 3)), ((1999, 2, 1), (1999, 2, 28)), ((2000, 2, 28), (2000, 3, 1)),
          ((2000, 5, 5), (2000, 5, 5)), ((2000, 5, 6), (2000, 5, 5)), ((1990, 1, 1), (1991, 1, 1)), ((1999, 11, 30), (2001, 1, 1))]


def some(rng, n):
    out = []
    for _ in range(n):
        day = dt.datetime(1999, 1, 1) + dt.timedelta(days=rng.choice([0, 58, 424, 425, 490, 730, rng.randrange(1095)]))
        time = rng.choice([dt.timedelta(0), dt.timedelta(seconds=86399), dt.timedelta(seconds=86399, milliseconds=500),
                           dt.timedelta(seconds=rng.randrange(86400))])
        out.append((None if rng.random() < 0.02 else day + time, None if rng.random() < 0.2 else Decimal(rng.randrange(9999)) / 100,
                    rng.choice([None, 0, 1, 7])))
    return out


def same(sales, tree):
    for a, b in RANGES:
        span = dt.date(*a), dt.date(*b)
        assert RS.totals_of(tree, *span).collect() == R.report_totals(sales, *span).collect()
        assert RS.daily_of(tree, *span).collect() == R.daily_sales(sales, *span).collect()
        assert RS.trend_of(tree, *span).collect() == R.sales_trend_binned(sales, *span).collect(), span


def test_equals_the_sales(spark):
    rng = random.Random(8)
    rows = some(rng, 400)
    frame = lambda r: spark.createDataFrame(r, SALES)
    tree = cut_lineage(RS.sum_tree(frame(rows)))
    same(frame(rows), tree)
    late, gone = some(rng, 30), rows[::2]
    tree = cut_lineage(RS.fold_sums(tree, frame(late), frame(gone)))
    rows = rows[1::2] + late
    same(frame(rows), tree)
    key = lambda r: (r.Level, r.Start)
    assert sorted(tree.collect(), key=key) == sorted(RS.sum_tree(frame(rows)).select(tree.columns).collect(), key=key)
    assert RS.fold_sums(tree, removed=frame(rows)).count() == 0


def test_a_range_is_a_few_dozen_nodes(spark):
    start = dt.datetime(1980, 1, 1)
    every = spark.createDataFrame([(start + dt.timedelta(days=i), Decimal(1), 1) for i in range(40 * 365)], SALES)
    tree = cut_lineage(RS.sum_tree(every))
    nodes = tree.where(RS.cover(dt.date(1981, 2, 2), dt.date(2018, 11, 29)))
    assert nodes.count() <= 2 * 30 + 2 * 11 + 38
    assert nodes.groupBy().sum("Sales").first()[0] == (dt.date(2018, 11, 29) - dt.date(1981, 2, 2)).days + 1


def test_folding_reads_only_the_batch(spark, tmp_path):
    for name in ("sales", "late"):
        spark.createDataFrame([(dt.datetime(2000, 1, 1), Decimal(2), 1)], SALES).write.parquet(str(tmp_path / name))
    tree = cut_lineage(RS.sum_tree(spark.read.parquet(str(tmp_path / "sales"))))
    after = RS.fold_sums(tree, spark.read.parquet(str(tmp_path / "late")))
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "late") in plan and str(tmp_path / "sales") not in plan
    assert RS.totals_of(after, dt.date(2000, 1, 1), dt.date(2000, 1, 1)).first().TotalItems == 2
