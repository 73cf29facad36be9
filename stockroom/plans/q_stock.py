"""Registered stock queries."""

from __future__ import annotations

from ..operators import stock as S
from .registry import query


@query("current_stock", """
SELECT p.ProductID, p.Name AS ProductName, p.Category,
       COALESCE(a.TotalAdded, 0) AS TotalAdded, COALESCE(s.TotalSold, 0) AS TotalSold,
       COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) AS CurrentStock,
       CASE WHEN COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) <= 0 THEN 'Out of Stock'
            WHEN COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) < 10 THEN 'Low Stock'
            ELSE 'In Stock' END AS Status
FROM products p
LEFT JOIN (SELECT ProductID, CAST(SUM(QuantityAdded) AS BIGINT) AS TotalAdded FROM stock GROUP BY ProductID) a
  ON p.ProductID = a.ProductID
LEFT JOIN (SELECT ProductID, CAST(SUM(QuantitySold) AS BIGINT) AS TotalSold FROM sales GROUP BY ProductID) s
  ON p.ProductID = s.ProductID
""")
def q_current_stock(t):
    """Received, sold and net stock with status, for every product."""
    return S.current_stock(t.products, t.stock, t.sales)


@query("sellable_products", """
SELECT p.*, COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) AS StockAvailable,
       CASE WHEN COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) < 5 THEN 'Low Stock'
            ELSE 'In Stock' END AS StockStatus
FROM products p
LEFT JOIN (SELECT ProductID, CAST(SUM(QuantityAdded) AS BIGINT) AS TotalAdded FROM stock GROUP BY ProductID) a
  ON p.ProductID = a.ProductID
LEFT JOIN (SELECT ProductID, CAST(SUM(QuantitySold) AS BIGINT) AS TotalSold FROM sales GROUP BY ProductID) s
  ON p.ProductID = s.ProductID
WHERE COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) > 0
""")
def q_sellable_products(t):
    """Products with net stock above zero, with the sale-form status label."""
    return S.sellable_products(t.products, t.stock, t.sales)


@query("shop_catalog", """
SELECT ProductID, Name, Category, Price, Description, units AS Stock FROM gross WHERE units > 0
""", extra_ctes="""
gross AS (SELECT ProductID, Name, Category, Price, Description,
                 CAST((SELECT SUM(r.QuantityAdded) FROM stock r WHERE r.ProductID = q.ProductID) AS BIGINT) AS units
          FROM products q)
""")
def q_shop_catalog(t):
    """Products with gross stock (sum of receipt lots) above zero."""
    return S.shop_catalog(t.products, t.stock)


# What each product received, every product on a row of its own (the sums are taken before products come in).
_GROSS = """
gross AS (SELECT ProductID, Name, Category, Price, Description,
                 CAST(COALESCE((SELECT SUM(r.QuantityAdded) FROM stock r WHERE r.ProductID = q.ProductID), 0)
                      AS BIGINT) AS units
          FROM products q)
"""


@query("low_stock_products", """
SELECT ProductID, Name, units AS TotalStock
FROM (SELECT *, row_number() OVER (ORDER BY units, ProductID) AS place FROM gross WHERE units < 10) low
WHERE place <= 5
""", extra_ctes=_GROSS)
def q_low_stock_products(t):
    """The five products with the least gross stock, under 10 units."""
    return S.low_stock_products(t.products, t.stock)


@query("low_stock_products_all", """
SELECT ProductID, Name, units AS TotalStock FROM gross WHERE units < 10
""", extra_ctes=_GROSS)
def q_low_stock_products_all(t):
    """Every product with less than 10 units of gross stock."""
    return S.low_stock_products(t.products, t.stock, k=None)


@query("low_lot_count", """
SELECT COUNT(*) AS LowLotCount FROM stock WHERE QuantityAdded < 10
""")
def q_low_lot_count(t):
    """Number of receipt lots holding fewer than 10 units."""
    return S.low_lot_count(t.stock)


@query("stock_availability", """
SELECT k.ProductID, COALESCE(a.TotalAdded, 0) AS TotalAdded, COALESCE(s.TotalSold, 0) AS TotalSold,
       COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) AS Available
FROM (SELECT DISTINCT ProductID FROM sale_requests WHERE ProductID IS NOT NULL) k
LEFT JOIN (SELECT ProductID, CAST(SUM(QuantityAdded) AS BIGINT) AS TotalAdded FROM stock GROUP BY ProductID) a
  ON k.ProductID = a.ProductID
LEFT JOIN (SELECT ProductID, CAST(SUM(QuantitySold) AS BIGINT) AS TotalSold FROM sales GROUP BY ProductID) s
  ON k.ProductID = s.ProductID
""")
def q_stock_availability(t):
    """Added / sold / available for every product id named in the sale requests."""
    return S.stock_availability(t.sale_requests, t.stock, t.sales)


@query("gross_stock", """
SELECT k.ProductID, COALESCE(a.TotalAdded, 0) AS GrossStock
FROM (SELECT DISTINCT ProductID FROM sale_requests WHERE ProductID IS NOT NULL) k
LEFT JOIN (SELECT ProductID, CAST(SUM(QuantityAdded) AS BIGINT) AS TotalAdded FROM stock GROUP BY ProductID) a
  ON k.ProductID = a.ProductID
""")
def q_gross_stock(t):
    """Gross stock (sum of all receipt lots) for every product id named in the sale requests."""
    return S.gross_stock(t.sale_requests, t.stock)


@query("stock_by_supplier", """
SELECT x.SupplierID, x.ProductID, sup.Name AS SupplierName, p.Name AS ProductName, x.TotalSupplied
FROM (SELECT SupplierID, ProductID, CAST(SUM(QuantityAdded) AS BIGINT) AS TotalSupplied
      FROM stock GROUP BY SupplierID, ProductID) x
JOIN products p ON x.ProductID = p.ProductID
JOIN suppliers sup ON x.SupplierID = sup.SupplierID
""")
def q_stock_by_supplier(t):
    """Units received per (supplier, product) with both names."""
    return S.stock_by_supplier(t.stock, t.products, t.suppliers)


# Lots of known products and suppliers, placed from the newest on; names are looked up one by one.
RECEIPTS = """
placed AS (SELECT StockID, ProductID, SupplierID, QuantityAdded, DateAdded,
                  row_number() OVER (ORDER BY DateAdded DESC, StockID DESC) AS place
           FROM stock
           WHERE ProductID IN (SELECT ProductID FROM products) AND SupplierID IN (SELECT SupplierID FROM suppliers)),
newest AS (SELECT StockID, ProductID, SupplierID,
                  (SELECT Name FROM products q WHERE q.ProductID = placed.ProductID) AS ProductName,
                  (SELECT Name FROM suppliers q WHERE q.SupplierID = placed.SupplierID) AS SupplierName,
                  QuantityAdded, DateAdded
           FROM placed WHERE place <= 10)
"""


@query("recent_receipts", "SELECT * EXCLUDE (ProductID, SupplierID) FROM newest", extra_ctes=RECEIPTS)
def q_recent_receipts(t):
    """The ten newest receipt lots with product and supplier names."""
    return S.recent_receipts(t.stock, t.products, t.suppliers)


@query("largest_lot", """
SELECT ProductID, StockID, QuantityAdded FROM (
  SELECT ProductID, StockID, QuantityAdded,
         row_number() OVER (PARTITION BY ProductID ORDER BY QuantityAdded DESC, StockID) AS rn
  FROM stock WHERE QuantityAdded >= 5) x
WHERE rn = 1
""")
def q_largest_lot(t):
    """Per product, the largest receipt lot that can cover a 5-unit reservation."""
    return S.largest_lot(t.stock, t.params.reserve_quantity)


@query("report_recent_stock", """
SELECT *, strftime(DateAdded, '%b %d, %Y') AS DateText, format('{:,}', QuantityAdded) AS QuantityText FROM newest
""", extra_ctes=RECEIPTS)
def q_report_recent_stock(t):
    """The report page's ten newest stock additions with names and display texts."""
    return S.report_recent_stock(t.stock, t.products, t.suppliers)
