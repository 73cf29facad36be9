"""Property tests on generated small tables."""

import datetime as dt
import math
from decimal import Decimal as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stockroom.operators import cart as C
from stockroom.operators import parties as PT
from stockroom.operators import reports as R
from stockroom.operators import sequential as Q
from stockroom.operators import stock as S
from stockroom.schema import from_rows

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
T0 = dt.datetime(2000, 6, 1)

sales_rows = st.lists(st.tuples(st.integers(0, 4), st.integers(1, 9), st.integers(0, 40),
                                st.integers(0, 5000)), max_size=30)
stock_rows = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 2), st.integers(1, 30)), max_size=20)


def make(spark, sales, stock):
    return from_rows(spark, {
        "products": [(i, f"p{i % 2}", "c", D("2.00"), "d") for i in range(5)],
        "suppliers": [(j, f"s{j}", "", None, "") for j in range(3)],
        "sales": [(i, p, q, T0 + dt.timedelta(days=d), D(cents) / 100, 1) for i, (p, q, d, cents) in enumerate(sales)],
        "stock": [(i, p, s, q, T0) for i, (p, s, q) in enumerate(stock)],
        "supplier_products": sorted({(s, p) for p, s, _ in stock}),
    })


@SETTINGS
@given(sales=sales_rows, stock=stock_rows)
def test_net_is_gross_minus_sold(spark, sales, stock):
    t = make(spark, sales, stock)
    got = {r.ProductID: (r.TotalAdded, r.TotalSold, r.CurrentStock) for r in
           S.current_stock(t.products, t.stock, t.sales).collect()}
    for p in range(5):
        added = sum(q for pp, _, q in stock if pp == p)
        sold = sum(q for pp, q, _, _ in sales if pp == p)
        assert got[p] == (added, sold, added - sold)


@SETTINGS
@given(sales=sales_rows, stock=stock_rows)
def test_fan_out_equals_literal_join(spark, sales, stock):
    t = make(spark, sales, stock)
    start, end = dt.date(2000, 6, 1), dt.date(2000, 6, 20)
    got = {r.SupplierID: (r.ProductCount, r.TotalSupplied)
           for r in R.supplier_volume(t.stock, t.sales, start, end).collect()}
    lit = {}
    for p, s, q in stock:
        for sp, _, d, _ in sales:
            if sp == p and d <= 19:
                c, tot = lit.get(s, (set(), 0))
                c.add(p)
                lit[s] = (c, tot + q)
    assert got == {s: (len(c), tot) for s, (c, tot) in lit.items()}


@SETTINGS
@given(sales=sales_rows)
def test_binned_trend_keeps_the_total(spark, sales):
    t = make(spark, sales, [])
    start, end = dt.date(2000, 1, 1), dt.date(2000, 12, 31)
    pts = R.sales_trend_binned(t.sales, start, end).collect()
    days = R.daily_sales(t.sales, start, end).collect()
    assert sum(p.Value for p in pts) == sum(d.DailyTotal for d in days)
    n = len(days)
    size = max(1, math.ceil(n / 10))
    assert len(pts) == math.ceil(n / size) <= 10


@SETTINGS
@given(sales=sales_rows)
def test_dense_series_has_seven_points(spark, sales):
    t = make(spark, sales, [])
    assert R.daily_sales_dense(t.sales, dt.date(2000, 6, 20)).count() == 7


@SETTINGS
@given(stock=stock_rows, pid=st.integers(0, 5))
def test_linked_and_available_partition_suppliers(spark, stock, pid):
    t = make(spark, [], stock)
    linked = {r.SupplierID for r in PT.product_suppliers(t.products, t.suppliers, t.supplier_products).collect()
              if r.ProductID == pid}
    avail = {r.SupplierID for r in PT.available_suppliers(t.suppliers, t.supplier_products, pid).collect()}
    assert linked | avail == {0, 1, 2} and not (linked & avail)


events = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.sampled_from(["add", "add", "remove", "buy"]),
                            st.integers(1, 3)), max_size=25)


@SETTINGS
@given(ev=events)
def test_cart_adds_are_bought_removed_or_open(spark, ev):
    t = from_rows(spark, {"products": [(0, "a", "c", D("1.00"), "d"), (1, "b", "c", D("1.00"), "d")],
                          "cart_events": [(i, T0 + dt.timedelta(minutes=i), u, p, a, q)
                                          for i, (u, p, a, q) in enumerate(ev)]})
    stt = C.cart_episodes(t.cart_events, t.products)
    added = sum(q for _, _, a, q in ev if a == "add")
    out = sum(r.quantity for r in C.cart_purchases(stt).collect()) + \
        sum(r.quantity for r in C.cart_removals(stt).collect()) + \
        sum(r.quantity for r in C.cart_open(stt).collect())
    assert out == added


@SETTINGS
@given(reqs=st.lists(st.tuples(st.integers(0, 2), st.integers(1, 12)), max_size=25),
       lots=st.lists(st.tuples(st.integers(0, 2), st.integers(1, 15)), max_size=8))
def test_record_sales_never_oversells(spark, reqs, lots):
    t = from_rows(spark, {
        "products": [(i, "p", "c", D("1.00"), "d") for i in range(3)],
        "stock": [(i, p, 1, q, T0) for i, (p, q) in enumerate(lots)],
        "sale_requests": [(i, T0 + dt.timedelta(seconds=i), p, str(q), None, 1) for i, (p, q) in enumerate(reqs)]})
    rec = Q.record_sales(t.products, t.stock, t.sales, t.sale_requests)
    sold = {}
    for r in rec.sales.collect():
        sold[r.ProductID] = sold.get(r.ProductID, 0) + r.QuantitySold
    for p in range(3):
        assert sold.get(p, 0) <= sum(q for pp, q in lots if pp == p)
    assert rec.sales.count() + rec.rejects.count() == len(reqs)


def _loop_record(reqs, lots):
    avail = {p: sum(q for pp, q in lots if pp == p) for p in range(3)}
    ok = set()
    for i, (p, q) in enumerate(reqs):
        if q <= avail[p]:
            avail[p] -= q
            ok.add(i)
    return ok


@SETTINGS
@given(reqs=st.lists(st.tuples(st.integers(0, 2), st.integers(1, 12)), max_size=25),
       lots=st.lists(st.tuples(st.integers(0, 2), st.integers(1, 15)), max_size=8))
def test_record_sales_equals_loop(spark, reqs, lots):
    t = from_rows(spark, {
        "products": [(i, "p", "c", D("1.00"), "d") for i in range(3)],
        "stock": [(i, p, 1, q, T0) for i, (p, q) in enumerate(lots)],
        "sale_requests": [(i, T0 + dt.timedelta(seconds=i), p, str(q), None, 1) for i, (p, q) in enumerate(reqs)]})
    rec = Q.record_sales(t.products, t.stock, t.sales, t.sale_requests)
    assert {r.request_id for r in rec.sales.collect()} == _loop_record(reqs, lots)


@SETTINGS
@given(reqs=st.lists(st.tuples(st.integers(0, 1), st.integers(1, 6)), max_size=20),
       lots=st.lists(st.tuples(st.integers(0, 1), st.integers(1, 9)), max_size=8),
       wave=st.sampled_from([2, 100]))
def test_reserve_equals_loop(spark, reqs, lots, wave):
    t = from_rows(spark, {"stock": [(i, p, 1, q, T0) for i, (p, q) in enumerate(lots)]})
    req_df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), p, q) for i, (p, q) in enumerate(reqs)],
                                   "request_id long, ts timestamp_ntz, ProductID long, q long")
    res = Q.reserve_stock(t.stock, req_df, wave_size=wave)
    state = {i: [q, p] for i, (p, q) in enumerate(lots)}
    exp = set()
    for i, (p, q) in enumerate(reqs):
        cands = [(v, -sid, sid) for sid, (v, pp) in state.items() if pp == p and v >= q]
        if cands:
            sid = max(cands)[2]
            state[sid][0] -= q
            exp.add((i, sid))
    assert {(r.request_id, r.StockID) for r in res.taken.collect()} == exp


@SETTINGS
@given(sales=st.lists(st.tuples(st.integers(0, 7), st.integers(0, 300)), max_size=30),
       k=st.integers(1, 12))
def test_top_k_named_equals_join_then_sort(spark, sales, k):
    from pyspark.sql import functions as F

    from stockroom.operators.topk import top_k_named

    # products 0..4 exist, 5..7 do not: candidates drop out of the join
    t = from_rows(spark, {"products": [(i, f"p{i}", "c", D("1.00"), "d") for i in range(5)],
                          "sales": [(i, p, 1, T0 + dt.timedelta(hours=h), D("1.00"), 1)
                                    for i, (p, h) in enumerate(sales)]})
    order = [F.desc("SaleDate"), F.desc("SaleID")]
    names = t.products.select("ProductID", "Name")
    got = top_k_named(t.sales, order, k, {"ProductID": names}).orderBy(*order)
    want = t.sales.join(names, "ProductID").orderBy(*order).limit(k)
    assert [r.SaleID for r in got.collect()] == [r.SaleID for r in want.collect()]
