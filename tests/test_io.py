"""Sources and sinks: parquet layout round trip, appends, CSV files."""

import datetime as dt
import os
import tempfile
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from data_paths import SMALL
from stockroom.operators import stock as S
from stockroom.schema import from_rows
from stockroom.sources import RetailTables, write_tables
from stockroom.sources import TableStore
from stockroom.sources.sinks import write_csv


def test_parquet_layout_round_trip(spark):
    src = RetailTables.from_testdata(spark, SMALL)
    out = tempfile.mkdtemp(prefix="stockroom-layout-")
    write_tables(src, out)
    back = RetailTables.from_parquet(spark, out)
    a = sorted(map(tuple, S.current_stock(src.products, src.stock, src.sales).collect()))
    b = sorted(map(tuple, S.current_stock(back.products, back.stock, back.sales).collect()))
    assert a == b
    assert os.path.isdir(os.path.join(out, "sales"))
    assert any(d.startswith("SaleMonth=") for d in os.listdir(os.path.join(out, "sales")))


def test_store_append_and_replace(spark):
    """Appends read back, also on the partitioned sales; a table can be replaced by its own rows."""
    sold = [(1, 1, 2, dt.datetime(2000, 1, 31), D("5.00"), 3), (2, 1, 1, dt.datetime(2000, 2, 1), D("2.50"), None)]
    t = from_rows(spark, {"products": [(1, "a", "c", D("1.00"), "d")], "sales": sold})
    store = TableStore(spark, tempfile.mkdtemp(prefix="stockroom-store-"))
    store.replace("sales", t.sales)
    new = t.sales.withColumn("SaleID", F.col("SaleID") + 10).withColumn("request_id", F.lit(7))
    store.append("sales", new)  # the request column is dropped, the month derived
    store.append("sales", new.withColumn("SaleID", F.col("SaleID") + 10))
    back = store.read("sales")
    assert sorted(r.SaleID for r in back.collect()) == [1, 2, 11, 12, 21, 22]
    assert {r.SaleMonth for r in back.collect()} == {"2000-01", "2000-02"}
    store.replace("sales", back.where("SaleID > 10"))
    assert store.read("sales").count() == 4 and store.version("sales") == 2
    store.compact("sales")
    store.drop_old("sales")
    assert store.read("sales").count() == 4 and store.version("sales") == 3
    assert store.tables().sales.count() == 4
    with pytest.raises(FileNotFoundError):
        store.read("products")


def test_store_refuses_what_does_not_fit(spark):
    store = TableStore(spark, tempfile.mkdtemp(prefix="stockroom-store-"))
    t = from_rows(spark, {"products": [(1, "a", "c", D("1.00"), "d")]})
    store.replace("products", t.products)
    for wrong in (t.products.drop("Price"), t.products.withColumn("Price", F.col("Price").cast("double"))):
        with pytest.raises(ValueError, match="Price"):
            store.append("products", wrong)


def test_store_ignores_a_failed_write(spark):
    """A version or append that was never committed doesn't count, and its number isn't used again."""
    root = tempfile.mkdtemp(prefix="stockroom-store-")
    t = from_rows(spark, {"products": [(1, "a", "c", D("1.00"), "d")]})
    store = TableStore(spark, root)
    store.replace("products", t.products)
    broken = t.products.withColumn("Name", F.raise_error(F.lit("stop")).cast("string"))
    for write in (store.replace, store.append):
        with pytest.raises(Exception, match="stop"):
            write("products", broken)
    assert store.read("products").count() == 1 and store.version("products") == 1
    store.append("products", t.products)
    store.replace("products", store.read("products"))
    assert store.read("products").count() == 2 and store.version("products") == 3


def test_csv_file_export(spark):
    t = from_rows(spark, {"products": [(1, 'x "y", z', "c", D("1.00"), "d")],
                          "stock": [(1, 1, 1, 3, dt.datetime(2000, 1, 1))]})
    out = tempfile.mkdtemp(prefix="stockroom-csv-")
    write_csv(S.current_stock(t.products, t.stock, t.sales).coalesce(1), out + "/cs")
    part = [f for f in os.listdir(out + "/cs") if f.endswith(".csv")][0]
    text = open(os.path.join(out, "cs", part)).read()
    assert text.splitlines()[0] == '"ProductID","ProductName","Category","TotalAdded","TotalSold","CurrentStock","Status"'
    assert text.splitlines()[1] == '"1","x ""y"", z","c","3","0","3","Low Stock"'


def test_stored_layout_prunes_months(spark):
    import contextlib
    import io

    from stockroom.plans import REGISTRY

    src = RetailTables.from_testdata(spark, SMALL)
    out = tempfile.mkdtemp(prefix="stockroom-prune-")
    write_tables(src, out)
    stored = RetailTables.from_parquet(spark, out)
    for name in ["category_breakdown", "sales_kpis", "daily_sales_dense_7d", "sales_history", "report_totals"]:
        a = REGISTRY[name].build(src)
        b = REGISTRY[name].build(stored)
        cols = [c for c in a.columns]
        assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect())), name
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        REGISTRY["category_breakdown"].build(stored).explain("formatted")
    text = buf.getvalue()
    assert "PartitionFilters" in text and "SaleMonth" in text.split("PartitionFilters")[1][:300]


def test_bucketed_tables_skip_shuffles(spark):
    import contextlib
    import io

    from stockroom.plans import REGISTRY
    from stockroom.sources import write_bucketed

    src = RetailTables.from_testdata(spark, SMALL)
    write_bucketed(src, "stockroom_test_b", 4, tempfile.mkdtemp(prefix="stockroom-bucket-"))
    b = RetailTables.from_catalog(spark, "stockroom_test_b")
    for name in ["shop_catalog", "stock_by_supplier", "current_stock"]:
        assert sorted(map(tuple, REGISTRY[name].build(src).collect())) == \
            sorted(map(tuple, REGISTRY[name].build(b).collect())), name
    for name in ["shop_catalog", "current_stock"]:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            REGISTRY[name].build(b).explain()
        assert "Exchange hashpartitioning" not in buf.getvalue(), name
