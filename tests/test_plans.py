"""Plan shape: filters reach the scan, top-k stays top-k, no cartesian products."""

import contextlib
import io

import pytest

from data_paths import SMALL
from stockroom.plans import REGISTRY
from stockroom.sources import RetailTables

SEQUENTIAL = {"record_sales", "record_sales_rejects", "reserve_stock", "reserve_stock_taken",
              "reserve_stock_rejects", "cart_stream_purchases", "cart_stream_errors", "record_sales_applied"}


def plan(spark, name):
    df = REGISTRY[name].build(RetailTables.from_testdata(spark, SMALL))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue() + df._jdf.queryExecution().optimizedPlan().toString()


def test_kpi_filter_pushed_to_scan(spark):
    p = plan(spark, "sales_kpis")
    assert "PushedFilters" in p and "l_shipdate" in p.split("PushedFilters")[1][:400]


def test_report_range_pushed(spark):
    p = plan(spark, "category_breakdown")
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThanOrEqual(l_shipdate" in p


@pytest.mark.parametrize("name", ["top_products_by_quantity", "top_products_by_revenue", "recent_receipts",
                                  "low_stock_products", "sales_history", "top_suppliers"])
def test_topk_is_take_ordered(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["top_products_by_quantity", "recent_receipts", "sales_history"])
def test_topk_meets_its_references_first(spark, name):
    """One lazy plan: semi-joins, then the top k, then the names; nothing was computed beforehand."""
    p = plan(spark, name)
    assert "LeftSemi" in p and "Scan ExistingRDD" not in p


def test_availability_semi_joins_before_it_aggregates(spark):
    for name in ("price_quote", "price_preview", "stock_availability", "gross_stock"):
        df = REGISTRY[name].build(RetailTables.from_testdata(spark, SMALL))
        tree = df._jdf.queryExecution().optimizedPlan().toString()
        after = tree[tree.index("Aggregate [ProductID"):]
        assert "LeftSemi" in after, name


@pytest.mark.parametrize("name", ["product_intake", "supplier_intake", "receive_stock", "category_chart_json",
                                  "sales_trend_binned", "cart_open"])
def test_no_window_over_one_partition(spark, name):
    p = plan(spark, name)
    assert not [at for at in range(len(p)) if p.startswith("Window", at) and "Exchange SinglePartition" in p[at:at + 400]]


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - SEQUENTIAL))
def test_no_cartesian(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_unused_line_id_window_is_pruned(spark):
    assert "Window" not in plan(spark, "current_stock")


def test_fan_out_join_not_built(spark):
    import datetime as dt

    from stockroom.operators.reports import supplier_volume

    t = RetailTables.from_testdata(spark, SMALL)
    p = supplier_volume(t.stock, t.sales, dt.date(2000, 6, 1), dt.date(2000, 6, 15))._jdf.queryExecution() \
        .optimizedPlan().toString()
    # receipts are summed per (supplier, product) and sales counted per product
    # before the one join between them; then one more aggregate per supplier
    assert p.count("Aggregate [SupplierID") >= 1 and p.count("Aggregate [ProductID") >= 1
    assert p.count("Join Inner") == 2  # the product join, plus the adapter's lineitem-orders join
