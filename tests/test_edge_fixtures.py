"""Hand-made edge fixtures (a few rows each), expected values derived by hand."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from stockroom.operators import cart as C
from stockroom.operators import changes as X
from stockroom.operators import parties as PT
from stockroom.operators import reports as R
from stockroom.operators import sales as SA
from stockroom.operators import sequential as Q
from stockroom.operators import stock as S
from stockroom.schema import SCHEMAS, from_rows
from stockroom.sources.sinks import csv_lines

T0 = dt.datetime(2000, 6, 15)
AS_OF = dt.date(2000, 6, 15)


def prod(pid, name="p", cat="c", price="1.00", desc="d"):
    return (pid, name, cat, D(price), desc)


def sale(sid, pid, qty, when, amount="1.00", user=1):
    return (sid, pid, qty, when, D(amount), user)


def lot(sid, pid, qty, supp=1, when=T0):
    return (sid, pid, supp, qty, when)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]


def test_product_without_receipts_is_zero_and_out(spark):
    t = from_rows(spark, {"products": [prod(1)]})
    r = S.current_stock(t.products, t.stock, t.sales).collect()[0]
    assert (r.TotalAdded, r.TotalSold, r.CurrentStock, r.Status) == (0, 0, 0, "Out of Stock")


def test_sold_more_than_received(spark):
    t = from_rows(spark, {"products": [prod(1)], "stock": [lot(1, 1, 5)], "sales": [sale(1, 1, 8, T0)]})
    assert rows(S.current_stock(t.products, t.stock, t.sales), "CurrentStock") == [(-3,)]
    assert S.sellable_products(t.products, t.stock, t.sales).count() == 0
    assert rows(S.shop_catalog(t.products, t.stock), "Stock") == [(5,)]


def test_status_edges(spark):
    nets = [0, 1, 4, 5, 9, 10]
    t = from_rows(spark, {"products": [prod(i) for i in range(6)],
                          "stock": [lot(i, i, n) for i, n in enumerate(nets) if n]})
    got = dict(rows(S.current_stock(t.products, t.stock, t.sales), "ProductID", "Status"))
    assert [got[i] for i in range(6)] == ["Out of Stock", "Low Stock", "Low Stock", "Low Stock", "Low Stock",
                                          "In Stock"]
    form = dict(rows(S.sellable_products(t.products, t.stock, t.sales), "ProductID", "StockStatus"))
    assert form == {1: "Low Stock", 2: "Low Stock", 3: "In Stock", 4: "In Stock", 5: "In Stock"}


def test_same_name_products_stay_apart(spark):
    t = from_rows(spark, {"products": [prod(1, "x"), prod(2, "x")],
                          "sales": [sale(1, 1, 3, T0), sale(2, 2, 4, T0)]})
    out = rows(R.top_products_by_quantity(t.sales, t.products), "ProductID", "TotalQuantity")
    assert out == [(2, 4), (1, 3)]


def test_supplier_fan_out_literal_and_corrected(spark):
    t = from_rows(spark, {"products": [prod(1)],
                          "suppliers": [(1, "s", "c", None, "")],
                          "stock": [lot(1, 1, 5), lot(2, 1, 7)],
                          "sales": [sale(i, 1, 1, T0) for i in range(3)]})
    lit_ = rows(R.top_suppliers(t.suppliers, t.stock, t.sales, AS_OF, AS_OF), "ProductCount", "TotalSupplied")
    fixed = rows(R.top_suppliers(t.suppliers, t.stock, t.sales, AS_OF, AS_OF, fanned=False), "TotalSupplied")
    assert lit_ == [(1, 36)] and fixed == [(12,)]


def test_not_in_with_null_link_is_empty(spark):
    t = from_rows(spark, {"suppliers": [(1, "a", "", None, ""), (2, "b", "", None, "")],
                          "supplier_products": [(None, 7), (1, 7)]})
    assert PT.available_suppliers(t.suppliers, t.supplier_products, 7).count() == 0
    t2 = from_rows(spark, {"suppliers": [(1, "a", "", None, ""), (2, "b", "", None, "")],
                           "supplier_products": [(1, 7)]})
    assert rows(PT.available_suppliers(t2.suppliers, t2.supplier_products, 7), "SupplierID", "OptionText") == \
        [(2, "b (No email)")]
    t3 = from_rows(spark, {"suppliers": [(1, "a", "", "a@x", ""), (None, "b", "", None, "")],
                           "supplier_products": [(1, 8)]})
    # no links for product 7: NOT IN over an empty set keeps every row, NULL ids included
    assert sorted(rows(PT.available_suppliers(t3.suppliers, t3.supplier_products, 7), "Name")) == [("a",), ("b",)]


def test_range_edges(spark):
    end = dt.date(2000, 6, 15)
    when = [dt.datetime(2000, 6, 1), dt.datetime(2000, 6, 15, 23, 59, 59),
            dt.datetime(2000, 6, 15, 23, 59, 59, 500000), dt.datetime(2000, 6, 16)]
    t = from_rows(spark, {"sales": [sale(i, 1, 1, w, "1.00") for i, w in enumerate(when)]})
    tot = R.report_totals(t.sales, dt.date(2000, 6, 1), end).collect()[0]
    assert tot.TotalItems == 2 and tot.TotalRevenue == D("2.00") and tot.Days == 15


def test_trailing_window_and_dense_series(spark):
    days = [8, 7, 6, 0]
    t = from_rows(spark, {"sales": [sale(i, 1, 1, T0 - dt.timedelta(days=d), "10.00") for i, d in enumerate(days)]})
    week = SA.sales_window_kpi(t.sales, AS_OF, "Week").collect()[0]
    assert week.SalesCount == 3
    dense = R.daily_sales_dense(t.sales, AS_OF).collect()
    assert len(dense) == 7 and [r.Total for r in dense] == [D("10.00")] + [D(0)] * 5 + [D("10.00")]
    assert dense[-1].Label == "Jun 15"


def test_month_edge(spark):
    t = from_rows(spark, {"sales": [sale(1, 1, 1, dt.datetime(1999, 1, 20))]})
    m = SA.sales_window_kpi(t.sales, dt.date(2000, 1, 20), "Month").collect()[0]
    assert (m.SalesCount, m.SalesTotal) == (0, 0)


@pytest.mark.parametrize("n,points", [(0, 0), (1, 1), (10, 10), (11, 6), (21, 7)])
def test_trend_sizes(spark, n, points):
    start = dt.date(2000, 1, 1)
    t = from_rows(spark, {"sales": [sale(i, 1, 1, dt.datetime(2000, 1, 1) + dt.timedelta(days=2 * i), "1.00")
                                    for i in range(n)]})
    out = R.sales_trend_binned(t.sales, start, dt.date(2000, 12, 31)).collect()
    assert len(out) == points
    assert sum(r.Value for r in out) == n
    if n == 11:
        assert out[0].Label == "Jan 01 - Jan 03" and out[-1].Label == "Jan 21"


def test_empty_range_and_zero_amount(spark):
    t = from_rows(spark, {"products": [prod(1)], "sales": [sale(1, 1, 2, T0, "0.00")]})
    empty = R.report_totals(t.sales, dt.date(1990, 1, 1), dt.date(1990, 1, 2)).collect()[0]
    assert (empty.TotalRevenue, empty.TotalItems) == (0, 0)
    assert R.top_products_by_revenue(t.sales, t.products, dt.date(1990, 1, 1), dt.date(1990, 1, 2)).count() == 0
    top = R.top_products_by_revenue(t.sales, t.products, AS_OF, AS_OF).collect()[0]
    assert top.Percentage is None


def test_inverted_dates_divide_by_one(spark):
    t = from_rows(spark, {"sales": [sale(1, 1, 1, T0, "30.00")]})
    r = R.report_totals(t.sales, dt.date(2000, 6, 16), dt.date(2000, 6, 14)).collect()[0]
    assert r.Days == 1


def test_duplicate_feed_rows_merge(spark):
    t = from_rows(spark, {"sales": [sale(1, 1, 2, T0), sale(2, 1, 2, T0)], "stock": [lot(1, 3, 4)]})
    feed = SA.recent_activity(t.sales, t.stock).collect()
    assert [r.Details for r in feed] == ["Sold 2 of product #1", "Added 4 to product #3"]


@pytest.mark.parametrize("n,pages", [(0, 0), (10, 1), (11, 2)])
def test_page_count(spark, n, pages):
    t = from_rows(spark, {"sales": [sale(i, 1, 1, T0) for i in range(n)]})
    assert SA.sales_page_count(t.sales).collect()[0].PageCount == pages


def test_paging_clamps_and_orders(spark):
    t = from_rows(spark, {"products": [prod(1)], "users": [(1, "u", 1)],
                          "sales": [sale(i, 1, 1, T0 + dt.timedelta(hours=i)) for i in range(11)]})
    p1 = rows(SA.sales_history(t.sales, t.products, t.users, page=0), "SaleID")
    p2 = rows(SA.sales_history(t.sales, t.products, t.users, page=2), "SaleID")
    p99 = SA.sales_history(t.sales, t.products, t.users, page=99).count()
    assert p1 == [(i,) for i in range(10, 0, -1)] and p2 == [(0,)] and p99 == 0


def test_search_is_literal_and_case_insensitive(spark):
    t = from_rows(spark, {"products": [prod(1, "50% off", "Misc"), prod(2, "a_b", "Misc"), prod(3, "Bolt", "TOOLS"),
                                       prod(4, "500 off", "Misc")]})
    assert rows(PT.product_search(t.products, term="%"), "ProductID") == [(1,)]
    assert rows(PT.product_search(t.products, term="_"), "ProductID") == [(2,)]
    assert rows(PT.product_search(t.products, term="tools"), "ProductID") == [(3,)]
    assert rows(PT.product_search(t.products, category="misc", term="off"), "ProductID") == [(1,), (4,)]


def test_intake_rejects_empty_like_text(spark):
    reqs = [(1, "", "c", "5", "d"), (2, " ", "c", "5", "d"), (3, "0", "c", "5", "d"), (4, None, "c", "5", "d"),
            (5, " ok ", "c", "5", " d "), (6, "ok", "c", "0", "d"), (7, "ok", "c", " 2.5abc", "d")]
    t = from_rows(spark, {"products": [prod(10)], "product_requests": reqs})
    res = X.product_intake(t.products, t.product_requests)
    assert sorted(rows(res.accepted, "ProductID", "Name", "Price", "Description", "request_id")) == [
        (11, "ok", D("5.00"), "d", 5), (12, "ok", D("2.50"), "d", 7)]
    assert sorted(r[0] for r in rows(res.rejects, "request_id")) == [1, 2, 3, 4, 6]


def test_display_defaults(spark):
    t = from_rows(spark, {"products": [prod(1, desc=""), prod(2, desc="0"), prod(3, desc=None), prod(4, desc="x")]})
    got = dict(rows(PT.product_detail(t.products), "ProductID", "DescriptionText"))
    assert got == {1: "No description available.", 2: "No description available.",
                   3: "No description available.", 4: "x"}


def test_role_cleaning(spark):
    t = from_rows(spark, {"users": [(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 4), (5, "e", 99)],
                          "roles": [(1, " Admin "), (2, "Custo mer"), (3, "manager"), (4, None)]})
    got = dict(rows(PT.user_roles(t.users, t.roles), "UserID", "Role"))
    assert got == {1: "admin", 2: "customer", 3: "staff", 4: "staff", 5: "staff"}


def test_csv_quoting(spark):
    df = spark.createDataFrame([('say "hi", then\nbye', 3)], "Name string, n long")
    assert csv_lines(df).collect()[0].line == '"say ""hi"", then\nbye","3"'


def test_record_sales_rejected_request_uses_no_stock(spark):
    t = from_rows(spark, {"products": [prod(1, price="2.00")], "stock": [lot(1, 1, 10)],
                          "sale_requests": [(i + 1, T0 + dt.timedelta(minutes=i), 1, q, None, 1)
                                            for i, q in enumerate(["6", "6", "4"])]})
    rec = Q.record_sales(t.products, t.stock, t.sales, t.sale_requests)
    assert sorted(rows(rec.sales, "request_id", "QuantitySold", "TotalAmount")) == [(1, 6, D("12.00")),
                                                                                   (3, 4, D("8.00"))]
    assert rows(rec.rejects, "request_id", "reason") == [(2, "Insufficient stock")]


def test_discount_forms(spark):
    reqs = [(i + 1, T0, 1, "1", d, 1) for i, d in enumerate(["", "x", "10", "150", "-5"])]
    t = from_rows(spark, {"products": [prod(1, price="100.00")], "stock": [lot(1, 1, 50)], "sale_requests": reqs})
    got = dict(rows(SA.price_quote(t.sale_requests, t.products, t.stock, t.sales), "request_id", "FinalAmount"))
    assert got == {1: D("100.00"), 2: D("100.00"), 3: D("90.00"), 4: D("-50.00"), 5: D("105.00")}


def test_reserve_largest_lot(spark):
    reqs = spark.createDataFrame([(1, T0, 1, 9), (2, T0 + dt.timedelta(seconds=1), 1, 6),
                                  (3, T0 + dt.timedelta(seconds=2), 1, 6)],
                                 "request_id long, ts timestamp_ntz, ProductID long, q long")
    t = from_rows(spark, {"stock": [lot(1, 1, 5), lot(2, 1, 8)]})
    res = Q.reserve_stock(t.stock, reqs)
    assert rows(res.taken, "request_id", "StockID") == [(2, 2)]
    assert sorted(r[0] for r in rows(res.rejects, "request_id")) == [1, 3]
    assert sorted(rows(res.stock, "StockID", "QuantityAdded")) == [(1, 5), (2, 2)]


def test_release_literal_and_once(spark):
    t = from_rows(spark, {"stock": [lot(1, 1, 5), lot(2, 1, 8)]})
    back = spark.createDataFrame([(1, 3)], "product_id long, quantity long")
    assert sorted(rows(X.release_stock(t.stock, back), "StockID", "QuantityAdded")) == [(1, 8), (2, 11)]
    assert sorted(rows(X.release_stock(t.stock, back, every_lot=False), "StockID", "QuantityAdded")) == \
        [(1, 8), (2, 8)]


def test_cart_sequence(spark):
    acts = [("add", 2), ("add", 1), ("buy", 1), ("buy", 1), ("add", 1), ("remove", 1), ("remove", 1)]
    ev = [(i + 1, T0 + dt.timedelta(minutes=i), 5, 1, a, q) for i, (a, q) in enumerate(acts)]
    t = from_rows(spark, {"products": [prod(1)], "cart_events": ev})
    st = C.cart_episodes(t.cart_events, t.products)
    assert rows(C.cart_purchases(st), "quantity", "event_id") == [(3, 3)]
    assert rows(C.cart_removals(st), "quantity", "event_id") == [(1, 6)]
    assert sorted(rows(C.cart_errors(st), "event_id", "reason")) == [(4, "not in cart"), (7, "not in cart")]
    assert C.cart_open(st).count() == 0


def test_cart_buy_of_missing_product_keeps_entry(spark):
    ev = [(1, T0, 5, 9, "add", 2), (2, T0 + dt.timedelta(minutes=1), 5, 9, "buy", 1)]
    t = from_rows(spark, {"products": [prod(1)], "cart_events": ev})
    st = C.cart_episodes(t.cart_events, t.products)
    assert rows(C.cart_errors(st), "event_id", "reason") == [(2, "product does not exist")]
    assert rows(C.cart_open(st), "product_id", "quantity") == [(9, 2)]


def test_cascades(spark):
    t = from_rows(spark, {"products": [prod(1), prod(2)], "suppliers": [(1, "s", "", None, ""), (2, "t", "", None, "")],
                          "stock": [lot(1, 1, 5, supp=1), lot(2, 2, 5, supp=2)],
                          "sales": [sale(1, 1, 1, T0), sale(2, 2, 1, T0)],
                          "supplier_products": [(1, 1), (2, 2)]})
    keys = spark.createDataFrame([(1,)], "ProductID long")
    d = X.delete_products(t.products, t.stock, t.sales, t.supplier_products, keys)
    assert [x.count() for x in (d.products, d.stock, d.sales, d.supplier_products)] == [1, 1, 1, 1]
    skeys = spark.createDataFrame([(2,)], "SupplierID long")
    e = X.delete_suppliers(t.suppliers, t.stock, t.sales, t.supplier_products, skeys)
    assert [x.count() for x in (e.suppliers, e.stock, e.sales, e.supplier_products)] == [1, 1, 2, 1]
    net = dict(rows(S.current_stock(t.products, e.stock, e.sales), "ProductID", "CurrentStock"))
    assert net == {1: 4, 2: -1}


def test_schemas_cover_all_tables():
    from stockroom.sources.retail import REQUEST_TABLES, TABLES

    assert set(TABLES) | set(REQUEST_TABLES) == set(SCHEMAS)


def test_receive_stock_creates_missing_link(spark):
    t = from_rows(spark, {"products": [prod(1)], "suppliers": [(3, "s", "", None, "")],
                          "stock": [lot(7, 1, 5, supp=3)], "supplier_products": [],
                          "receipt_requests": [(1, 1, 3, "4", None), (2, 1, 3, "4", T0), (3, 0, 3, "4", T0),
                                               (4, 1, 3, "x", T0), (5, 2, 3, "1", T0)]})
    r = X.receive_stock(t.stock, t.supplier_products, t.products, t.suppliers, t.receipt_requests, AS_OF)
    assert sorted(rows(r.stock, "StockID", "request_id", "DateAdded")) == [
        (8, 1, dt.datetime(2000, 6, 15)), (9, 2, T0)]
    assert rows(r.links, "SupplierID", "ProductID") == [(3, 1)]
    assert dict(rows(r.rejects, "request_id", "reason")) == {3: "invalid receipt fields", 4: "invalid receipt fields",
                                                            5: "unknown product"}
    assert F is not None


def test_default_report_range_and_texts(spark):
    from stockroom.functions import count_text, money_text, percent_text, report_range
    from stockroom.params import DEFAULT

    assert report_range(DEFAULT.as_of) == (DEFAULT.report_start, DEFAULT.report_end)
    assert report_range(dt.date(2001, 1, 1)) == (dt.date(2001, 1, 1), dt.date(2001, 1, 1))
    df = spark.createDataFrame([(D("1234567.5"), 12345, 12.34)], "m decimal(14,2), n long, p double")
    r = df.select(money_text("m").alias("a"), count_text("n").alias("b"), percent_text("p").alias("c")).collect()[0]
    assert (r.a, r.b, r.c) == ("$1,234,567.50", "12,345", "12.3%")


def test_cart_add_without_quantity_counts_one(spark):
    ev = [(1, T0, 5, 1, "add", None), (2, T0 + dt.timedelta(minutes=1), 5, 1, "add", 2),
          (3, T0 + dt.timedelta(minutes=2), 5, 1, "buy", None)]
    t = from_rows(spark, {"products": [prod(1)], "cart_events": ev})
    st = C.cart_episodes(t.cart_events, t.products)
    assert rows(C.cart_purchases(st), "quantity") == [(3,)]


def test_topk_grows_when_candidates_drop_out(spark):
    # the 12 newest sales name a product that does not exist, so the first
    # 10 candidates all drop out of the inner join and the set must grow
    sales = [sale(i, 1 if i < 3 else 99, 1, T0 + dt.timedelta(hours=i)) for i in range(15)]
    t = from_rows(spark, {"products": [prod(1)], "users": [(1, "u", 1)], "sales": sales})
    assert rows(SA.sales_history(t.sales, t.products, t.users, page=1), "SaleID") == [(2,), (1,), (0,)]


def test_top_k_skips_rows_without_references(spark):
    """Rows of unknown products never stand in the way of later ones."""
    lots = [(i, i % 4, 1, 5, dt.datetime(2000, 1, 1) + dt.timedelta(days=i)) for i in range(40)]
    t = from_rows(spark, {"stock": lots, "products": [(1, "a", "c", D("1.00"), ""), (3, "b", "c", D("1.00"), "")],
                          "suppliers": [(1, "s", "", "", "")]})
    got = [r.StockID for r in S.recent_receipts(t.stock, t.products, t.suppliers).collect()]
    assert got == [i for i in range(39, -1, -1) if i % 4 in (1, 3)][:10]
    none = from_rows(spark, {"stock": lots})
    assert S.recent_receipts(none.stock, none.products, none.suppliers).count() == 0


def test_numbers_too_large_are_rejected(spark):
    """Overlong prices, quantities and discounts reject their own request and nothing else."""
    from stockroom.operators import changes as X
    from stockroom.operators import sales as SL
    from stockroom.operators import sequential as Q

    t0 = dt.datetime(2000, 1, 1)
    asks = ["5", "5.0", "1e1", "5.5", "9000000000000000000", "1e30", "2", "2", "2"]
    off = ["", "10", "0.00001", "", "", "", "1e20", "99999999", "x"]
    t = from_rows(spark, {
        "products": [(1, "a", "c", D("9999999999.99"), ""), (2, "b", "c", D("2.00"), "")],
        "stock": [(1, 2, 1, 100, t0)],
        "product_requests": [(i, "n", "c", p, "") for i, p in enumerate(["99999999999", "1e30", "1.005", "-1", "3x"])],
        "sale_requests": [(i, t0, 2, a, o, 1) for i, (a, o) in enumerate(zip(asks, off))]})
    got = X.product_intake(t.products, t.product_requests)
    assert {r.request_id: r.Price for r in got.accepted.collect()} == {2: D("1.01"), 4: D("3.00")}
    rec = Q.record_sales(t.products, t.stock, t.sales, t.sale_requests)
    sold = {r.request_id: (r.QuantitySold, r.TotalAmount) for r in rec.sales.collect()}
    assert sold == {0: (5, D("10.00")), 1: (5, D("9.00")), 2: (10, D("20.00")), 7: (2, D("-3999995.96")),
                    8: (2, D("4.00"))}
    why = {r.request_id: r.reason for r in rec.rejects.collect()}
    assert why == {3: Q.INVALID_QUANTITY, 4: Q.AMOUNT_OUT_OF_RANGE, 5: Q.INVALID_QUANTITY, 6: Q.AMOUNT_OUT_OF_RANGE}
    quote = {r.request_id: r for r in SL.price_quote(t.sale_requests, t.products, t.stock, t.sales).collect()}
    assert quote[4].Subtotal is None and quote[4].FinalAmount is None and quote[4].ExceedsStock
    assert quote[6].FinalAmount is None and quote[1].FinalAmount == D("9.00")


def test_history_filters_take_form_text(spark):
    from stockroom.operators import sales as SL

    sold = [(i, 1 + i % 2, 1, dt.datetime(2000, 6, i), D("1.00"), 1) for i in range(1, 20)]
    t = from_rows(spark, {"sales": sold, "products": [(1, "a", "c", D("1.00"), ""), (2, "b", "c", D("1.00"), "")],
                          "users": [(1, "u", 1)]})
    got = SL.sales_history(t.sales, t.products, t.users, 1, "2000-06-05", " 2000-06-12 ", "2")
    assert [r.SaleID for r in got.collect()] == [11, 9, 7, 5]
    assert SL.sales_history(t.sales, t.products, t.users, 1, "", None, "0").count() == 10
