"""Batches that may be run again."""

import datetime as dt
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from stockroom.operators import changes as X
from stockroom.operators import sequential as Q
from stockroom.schema import from_rows
from stockroom.sources.store import TableStore


def test_batches_run_again_add_nothing_and_no_table_is_read_for_its_ids(spark, monkeypatch):
    day = dt.datetime(2000, 1, 1)
    t = from_rows(spark, {"stock": [(7, 1, 1, 10, day)], "sales": [], "products": [(1, "a", "c", Decimal("2.00"), "d")], "suppliers": [(1, "s", "", "", "")],
                          "supplier_products": []})
    store = TableStore(spark, tempfile.mkdtemp(prefix="stockroom-once-"))
    for name in ("stock", "sales"):
        store.replace(name, getattr(t, name))

    def requests(*rows):
        return spark.createDataFrame([(i, day + dt.timedelta(minutes=i), 1, str(q), None, 3) for i, q in rows],
                                     "request_id long, ts timestamp_ntz, ProductID long, Quantity string, Discount string, UserID long")

    def sell(fresh, last):
        done = Q.record_sales(t.products, store.read("stock"), store.read("sales"), fresh, last)
        return done.sales, done.rejects

    run = lambda r: store.run_once("sales", "SaleID", r, sell)
    first = requests((1, 4), (2, 9), (3, 5))
    assert run(first) == 2 and run(first) == 0 and run(first.unionAll(requests((4, 1), (5, 1)))) == 1
    got = sorted((r.SaleID, r.QuantitySold) for r in store.read("sales").collect())
    assert got == [(1, 4), (2, 5), (3, 1)] and store.last_id("sales", "SaleID") == 3
    assert sorted(r.request_id for r in store.decided("sales").collect()) == [1, 2, 3, 4, 5]
    # A failure between the rows and the list of the rejected: what was accepted is known from the rows.
    ledger = spark.createDataFrame([], "request_id long")
    ledger.write.mode("overwrite").parquet(f"{store.root}/sales.decided")
    assert run(first) == 0 and store.read("sales").count() == 3
    monkeypatch.setattr(store, "read", lambda table: 1 / 0)
    assert store.last_id("sales", "SaleID") == 3  # from the name of the last part


def test_ids_go_on_and_the_table_keeps_its_columns(spark):
    day = dt.datetime(2000, 1, 1)
    t = from_rows(spark, {"stock": [(7, 1, 1, 10, day)], "products": [(1, "a", "c", Decimal("2.00"), "d")], "suppliers": [(1, "s", "", "", "")],
                          "supplier_products": []})
    store = TableStore(spark, tempfile.mkdtemp(prefix="stockroom-once-"))
    store.replace("stock", t.stock)
    schema = "request_id long, product_id long, supplier_id long, quantity string, date_added timestamp_ntz"

    def receive(fresh, last):
        given = spark.createDataFrame([(last,)], "StockID long")
        done = X.receive_stock(given, t.supplier_products, t.products, t.suppliers, fresh, dt.date(2000, 2, 2))
        return done.stock, done.rejects

    for n in (1, 2, 3):
        rows = spark.createDataFrame([(i, 1 if i % 3 else 9, 1, "5", None) for i in range(4 * n)], schema)
        store.run_once("stock", "StockID", rows, receive)
    got = store.read("stock")
    assert got.columns == t.stock.columns
    assert sorted(r.StockID for r in got.collect()) == [7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert got.where(F.col("StockID") > 7).count() == sum(i % 3 != 0 for i in range(12))
