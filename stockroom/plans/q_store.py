"""Registered jobs that write their result to stored tables and read them back."""

from __future__ import annotations

import os
import uuid

from ..operators import changes as X
from ..operators import maintained as M
from ..operators import sequential as Q
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.store import TableStore
from .q_changes import EDITS, RECEIVED, UPSERTED
from .q_sequential import FOLD, RECORDED
from .registry import query


def _store(t) -> TableStore:
    """A new store in the shared folder."""
    return TableStore(t.spark, os.path.join(ensure_checkpoint_dir(t.spark), f"store-{uuid.uuid4().hex}"))


@query("product_upsert_applied", UPSERTED, extra_ctes=EDITS)
def q_product_upsert_applied(t):
    """The stored products table, replaced by its own edited rows, as read back."""
    store = _store(t)
    store.replace("products", t.products)
    store.replace("products", X.product_upsert(store.read("products"), t.product_edits).accepted)
    return store.read("products")


_WITH_SALES = f"""
SELECT SaleID, ProductID, QuantitySold, SaleDate, TotalAmount, UserID, strftime(SaleDate, '%Y-%m') AS SaleMonth
FROM (SELECT SaleID, ProductID, QuantitySold, SaleDate, TotalAmount, UserID FROM sales
      UNION ALL SELECT SaleID, ProductID, QuantitySold, SaleDate, TotalAmount, UserID FROM ({RECORDED}) r) x
"""


@query("record_sales_applied", _WITH_SALES, extra_ctes=FOLD, recursive=True)
def q_record_sales_applied(t):
    """The stored sales table, by month, with the newly recorded sales appended, as read back."""
    store = _store(t)
    store.replace("sales", t.sales)
    store.append("sales", Q.record_sales(t.products, t.stock, store.read("sales"), t.sale_requests).sales)
    return store.read("sales")


@query("record_sales_twice", _WITH_SALES, extra_ctes=FOLD, recursive=True)
def q_record_sales_twice(t):
    """The stored sales table after a batch of sale requests was applied, and run again, as read back."""
    store = _store(t)
    store.replace("sales", t.sales)

    def job(requests, last):
        done = Q.record_sales(t.products, t.stock, store.read("sales"), requests, last)
        return done.sales, done.rejects

    for _ in range(2):
        store.run_once("sales", "SaleID", t.sale_requests, job)
    return store.read("sales")


_WITH_RECEIPTS = """
SELECT * FROM stock UNION ALL
SELECT (SELECT COALESCE(MAX(StockID), 0) FROM stock) + row_number() OVER (ORDER BY request_id) AS StockID,
       ProductID, SupplierID, QuantityAdded, DateAdded
FROM rq2 WHERE reason IS NULL
"""


@query("receive_stock_twice", _WITH_RECEIPTS, extra_ctes=RECEIVED)
def q_receive_stock_twice(t):
    """The stored stock table after a batch of receipts was applied, and run again, as read back."""
    store = _store(t)
    store.replace("stock", t.stock)

    def job(requests, last):
        given = t.spark.createDataFrame([(last,)], "StockID long")  # ids go on from the mark, the table isn't read
        done = X.receive_stock(given, t.supplier_products, t.products, t.suppliers, requests, t.params.as_of)
        return done.stock, done.rejects

    for _ in range(2):
        store.run_once("stock", "StockID", t.receipt_requests, job)
    return store.read("stock")


@query("receive_stock_applied", _WITH_RECEIPTS, extra_ctes=RECEIVED)
def q_receive_stock_applied(t):
    """The stored stock table with the valid receipts appended, as read back."""
    store = _store(t)
    store.replace("stock", t.stock)
    new = X.receive_stock(store.read("stock"), t.supplier_products, t.products, t.suppliers, t.receipt_requests,
                          t.params.as_of)
    store.append("stock", new.stock)
    return store.read("stock")


@query("delete_products_applied", """
SELECT * FROM stock WHERE NOT EXISTS (
  SELECT 1 FROM products p WHERE p.ProductID = stock.ProductID AND p.Category = 'PROMO')
""")
def q_delete_products_applied(t):
    """The stored stock table after the cascading delete of the PROMO category was written back to it."""
    store = _store(t)
    for name in ("products", "stock", "sales", "supplier_products"):
        store.replace(name, getattr(t, name))
    now = store.tables(t.params)
    keys = now.products.where("Category = 'PROMO'").select("ProductID")
    left = X.delete_products(now.products, now.stock, now.sales, now.supplier_products, keys)
    for name in ("stock", "sales", "supplier_products", "products"):
        store.replace(name, getattr(left, name))
    return store.read("stock")


@query("current_stock_maintained", f"""
SELECT p.ProductID, p.Name AS ProductName, CAST(COALESCE(a.q, 0) AS BIGINT) AS TotalAdded, CAST(COALESCE(s.q, 0) AS BIGINT) AS TotalSold,
       CAST(COALESCE(a.q, 0) - COALESCE(s.q, 0) AS BIGINT) AS CurrentStock
FROM products p
LEFT JOIN (SELECT ProductID, SUM(QuantityAdded) AS q FROM stock WHERE SupplierID % 7 <> 0 GROUP BY ProductID) a ON a.ProductID = p.ProductID
LEFT JOIN (SELECT ProductID, SUM(QuantitySold) AS q FROM (
             SELECT ProductID, QuantitySold FROM sales UNION ALL SELECT ProductID, QuantitySold FROM ({RECORDED}) r) x
           GROUP BY ProductID) s ON s.ProductID = p.ProductID
""", extra_ctes=FOLD, recursive=True)
def q_current_stock_maintained(t):
    """Current stock from stored levels into which a batch of sales, and then the removal of some suppliers' lots, were folded."""
    levels = cut_lineage(M.fold_levels(M.level_changes(stock_added=t.stock.limit(0)), M.level_changes(t.stock, sales_added=t.sales)))
    sold = cut_lineage(Q.record_sales(t.products, t.stock, t.sales, t.sale_requests).sales)
    levels = cut_lineage(M.fold_levels(levels, M.level_changes(sales_added=sold)))
    gone = t.stock.where("SupplierID % 7 = 0")
    return M.stock_from_levels(t.products, M.fold_levels(levels, M.level_changes(stock_removed=gone)))
