"""Registered sink renderings: CSV export lines and chart JSON."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import stock as S
from ..operators.scan import number_rows
from ..session import ensure_checkpoint_dir
from ..sources.sinks import export_file, export_lines, header_line
from .q_parties import _CURRENT
from .q_stock import RECEIPTS
from .registry import query


def _q(cols):
    return " || ',' || ".join(f"'\"' || replace(CAST({c} AS VARCHAR), '\"', '\"\"') || '\"'" for c in cols)


# ---- fixed values: header rows of the exported tables -------------------------
CURRENT_HEADER = ["Product Name", "Category", "Total Added", "Total Sold", "Current Stock", "Status"]
HISTORY_HEADER = ["Stock ID", "Product", "Supplier", "Quantity Added", "Date Added"]
SUPPLIER_HEADER = ["Supplier", "Product", "Total Supplied"]
TOP_PRODUCTS_HEADER = ["Product", "Units Sold", "Revenue", "% of Total"]
TOP_SUPPLIERS_HEADER = ["Supplier", "Products", "Units Supplied"]
RECENT_HEADER = ["Date", "Product", "Supplier", "Quantity"]
DAILY_HEADER = ["Date", "Revenue"]


def _file(header, cols, rows):
    """Oracle of an export file: the header line and a line for each row."""
    head = ",".join('"' + h + '"' for h in header)
    return (f"SELECT '{head}' AS line, true AS is_header UNION ALL "
            f"SELECT {_q(cols)} AS line, false AS is_header FROM ({rows}) r")


_CS = ["ProductName", "Category", "TotalAdded", "TotalSold", "CurrentStock", "Status"]


@query("current_stock_csv", _file(CURRENT_HEADER, _CS, "SELECT * FROM current"), extra_ctes=_CURRENT)
def q_current_stock_csv(t):
    """The current-stock export file: header row and every product, all fields quoted, quotes doubled."""
    return export_lines(S.current_stock(t.products, t.stock, t.sales).select(_CS), CURRENT_HEADER)


_SBS = ["SupplierName", "ProductName", "TotalSupplied"]


@query("stock_by_supplier_csv", _file(SUPPLIER_HEADER, _SBS, """
  SELECT (SELECT Name FROM suppliers s WHERE s.SupplierID = x.SupplierID) AS SupplierName,
         (SELECT Name FROM products p WHERE p.ProductID = x.ProductID) AS ProductName, x.TotalSupplied
  FROM (SELECT SupplierID, ProductID, CAST(SUM(QuantityAdded) AS BIGINT) AS TotalSupplied FROM stock
        WHERE SupplierID IN (SELECT SupplierID FROM suppliers) AND ProductID IN (SELECT ProductID FROM products)
        GROUP BY ALL) x
"""))
def q_stock_by_supplier_csv(t):
    """The supplier-stock export file: header row and units per (supplier, product)."""
    return export_lines(S.stock_by_supplier(t.stock, t.products, t.suppliers).select(_SBS), SUPPLIER_HEADER)


@query("trend_chart_json", """
SELECT to_json(list(Label ORDER BY Point)) AS Labels,
       to_json(list(Value ORDER BY Point)) AS Values
FROM points
""", extra_ctes="""
days AS (SELECT CAST(SaleDate AS DATE) AS SaleDay, SUM(TotalAmount) AS DailyTotal
         FROM sales WHERE SaleDate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '2001-12-31 23:59:59'
         GROUP BY 1),
numbered AS (SELECT SaleDay, DailyTotal, row_number() OVER (ORDER BY SaleDay) AS rn,
                    COUNT(*) OVER () AS n FROM days),
pts AS (SELECT CAST(FLOOR((rn - 1) / CEIL(n / 10.0)) AS INTEGER) AS Point,
               MIN(SaleDay) AS FirstDay, MAX(SaleDay) AS LastDay, SUM(DailyTotal) AS Value
        FROM numbered GROUP BY 1),
points AS (SELECT Point, Value,
                  CASE WHEN FirstDay = LastDay THEN strftime(FirstDay, '%b %d')
                       ELSE strftime(FirstDay, '%b %d') || ' - ' || strftime(LastDay, '%b %d') END AS Label
           FROM pts)
""")
def q_trend_chart_json(t):
    """The binned trend as the chart's JSON label and value arrays."""
    pts = R.sales_trend_binned(t.sales, t.params.long_start, t.params.long_end)
    return R.chart_series_json(pts, "Point", "Label", "Value")


_RR = ["StockID", "ProductName", "SupplierName", "QuantityAdded", "DateAdded"]


@query("recent_receipts_csv", _file(HISTORY_HEADER, _RR, "SELECT * FROM newest"), extra_ctes=RECEIPTS)
def q_recent_receipts_csv(t):
    """The stock-history export file: header row and the latest receipts."""
    return export_lines(S.recent_receipts(t.stock, t.products, t.suppliers), HISTORY_HEADER)


_IN_RANGE = "SaleDate >= TIMESTAMP '2000-06-01 00:00:00' AND SaleDate <= TIMESTAMP '2000-06-15 23:59:59'"


@query("report_totals_csv", _file(["Total Revenue", "Total Items", "Daily Average"], ["a", "b", "c"], f"""
  SELECT COALESCE(SUM(TotalAmount), 0) AS a, CAST(COALESCE(SUM(QuantitySold), 0) AS BIGINT) AS b,
         CAST(COALESCE(SUM(TotalAmount), 0) / 15 AS DECIMAL(18,2)) AS c
  FROM sales WHERE {_IN_RANGE}"""))
def q_report_totals_csv(t):
    """Report export: the range's totals."""
    totals = R.report_totals(t.sales, t.params.report_start, t.params.report_end)
    average = (F.col("TotalRevenue") / F.col("Days")).cast("decimal(18,2)")
    return export_lines(totals.select("TotalRevenue", "TotalItems", average.alias("Average")),
                        ["Total Revenue", "Total Items", "Daily Average"])


@query("top_products_csv", _file(TOP_PRODUCTS_HEADER, ["Name", "TotalSold", "Revenue", "Share"], f"""
  SELECT Name, TotalSold, Revenue, CAST(ROUND(100 * Revenue / whole, 1) AS DECIMAL(5,1)) AS Share FROM (
    SELECT ProductID, CAST(SUM(QuantitySold) AS BIGINT) AS TotalSold, SUM(TotalAmount) AS Revenue,
           SUM(SUM(TotalAmount)) OVER () AS whole
    FROM sales WHERE {_IN_RANGE} GROUP BY ProductID) x
  SEMI JOIN products USING (ProductID) JOIN products USING (ProductID)
  QUALIFY row_number() OVER (ORDER BY Revenue DESC, ProductID) <= 5"""))
def q_top_products_csv(t):
    """Report export: the top products with their share of the range's revenue."""
    top = R.top_products_by_revenue(t.sales, t.products, t.params.report_start, t.params.report_end)
    share = F.round("Percentage", 1).cast("decimal(5,1)")
    return export_lines(top.select("Name", "TotalSold", "Revenue", share.alias("Share")), TOP_PRODUCTS_HEADER)


@query("top_suppliers_csv", _file(TOP_SUPPLIERS_HEADER, ["SupplierName", "ProductCount", "TotalSupplied"], f"""
  WITH hits AS (SELECT ProductID, COUNT(*) AS n FROM sales WHERE {_IN_RANGE} GROUP BY ProductID)
  SELECT Name AS SupplierName, ProductCount, TotalSupplied FROM (
    SELECT SupplierID, COUNT(DISTINCT ProductID) AS ProductCount, CAST(SUM(QuantityAdded * n) AS BIGINT) AS TotalSupplied
    FROM stock JOIN hits USING (ProductID) GROUP BY SupplierID) x JOIN suppliers USING (SupplierID)
  QUALIFY row_number() OVER (ORDER BY TotalSupplied DESC, SupplierID) <= 5"""))
def q_top_suppliers_csv(t):
    """Report export: the top suppliers."""
    top = R.top_suppliers(t.suppliers, t.stock, t.sales, t.params.report_start, t.params.report_end)
    return export_lines(top.select("SupplierName", "ProductCount", "TotalSupplied"), TOP_SUPPLIERS_HEADER)


@query("category_csv", _file(["Category", "Revenue"], ["Category", "Revenue"], f"""
  SELECT Category, SUM(Part) AS Revenue FROM (
    SELECT (SELECT Category FROM products p WHERE p.ProductID = s.ProductID) AS Category, SUM(TotalAmount) AS Part
    FROM sales s WHERE {_IN_RANGE} AND ProductID IN (SELECT ProductID FROM products) GROUP BY ProductID) x
  GROUP BY Category"""))
def q_category_csv(t):
    """Report export: revenue by category."""
    return export_lines(R.category_breakdown(t.sales, t.products, t.params.report_start, t.params.report_end),
                        ["Category", "Revenue"])


@query("report_recent_stock_csv", _file(RECENT_HEADER, ["d", "ProductName", "SupplierName", "QuantityAdded"], """
  SELECT strftime(DateAdded, '%b %d, %Y') AS d, ProductName, SupplierName, QuantityAdded FROM newest"""),
       extra_ctes=RECEIPTS)
def q_report_recent_stock_csv(t):
    """Report export: the recent stock additions."""
    recent = S.report_recent_stock(t.stock, t.products, t.suppliers)
    return export_lines(recent.select("DateText", "ProductName", "SupplierName", "QuantityAdded"), RECENT_HEADER)


@query("daily_sales_csv", _file(DAILY_HEADER, ["SaleDay", "DailyTotal"], """
  SELECT CAST(SaleDate AS DATE) AS SaleDay, SUM(TotalAmount) AS DailyTotal FROM sales
  WHERE SaleDate BETWEEN TIMESTAMP '2000-06-01 00:00:00' AND TIMESTAMP '2000-06-15 23:59:59' GROUP BY 1"""))
def q_daily_sales_csv(t):
    """Report export: the range's daily revenue."""
    return export_lines(R.daily_sales(t.sales, t.params.report_start, t.params.report_end), DAILY_HEADER)


@query("receipts_file", _file(HISTORY_HEADER, _RR, """
  SELECT s.StockID, p.Name AS ProductName, u.Name AS SupplierName, s.QuantityAdded, s.DateAdded
  FROM stock s JOIN products p ON s.ProductID = p.ProductID JOIN suppliers u ON s.SupplierID = u.SupplierID"""))
def q_receipts_file(t):
    """The stock history exported as one ordered file, newest first, as its lines are read back."""
    path = os.path.join(ensure_checkpoint_dir(t.spark), f"receipts-{uuid.uuid4().hex}.csv")
    export_file(S.receipt_history(t.stock, t.products, t.suppliers), HISTORY_HEADER,
                [F.desc("DateAdded"), F.desc("StockID")], path)
    lines = t.spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")
    return lines.withColumn("is_header", F.col("line") == header_line(HISTORY_HEADER))


@query("dense_7d_chart_json", """
SELECT to_json(list(Label ORDER BY Position)) AS Labels, to_json(list(Total ORDER BY Position)) AS Values
FROM (SELECT g.Position, strftime(g.SaleDay, '%b %d') AS Label,
             CAST(COALESCE(d.Total, 0) AS DECIMAL(24,2)) AS Total
      FROM (SELECT CAST(i AS INTEGER) AS Position, CAST(DATE '2000-06-15' - CAST(6 - i AS INTEGER) AS DATE) AS SaleDay
            FROM range(7) r(i)) g
      LEFT JOIN (SELECT CAST(SaleDate AS DATE) AS SaleDay, SUM(TotalAmount) AS Total FROM sales
                 WHERE SaleDate >= TIMESTAMP '2000-06-09 00:00:00' AND SaleDate < TIMESTAMP '2000-06-16 00:00:00'
                 GROUP BY 1) d ON g.SaleDay = d.SaleDay) x
""")
def q_dense_7d_chart_json(t):
    """The dashboard's 7-day revenue chart as JSON label and value arrays."""
    pts = R.daily_sales_dense(t.sales, t.params.as_of)
    return R.chart_series_json(pts, "Position", "Label", "Total")


@query("category_chart_json", """
SELECT to_json(list(Category ORDER BY Revenue DESC, Category)) AS Labels,
       to_json(list(Revenue ORDER BY Revenue DESC, Category)) AS Values
FROM (SELECT p.Category, SUM(s.TotalAmount) AS Revenue FROM sales s JOIN products p ON s.ProductID = p.ProductID
      WHERE s.SaleDate BETWEEN TIMESTAMP '2000-06-01 00:00:00' AND TIMESTAMP '2000-06-15 23:59:59'
      GROUP BY p.Category) c
""")
def q_category_chart_json(t):
    """The report's category chart as JSON label and value arrays (highest revenue first)."""
    cats = R.category_breakdown(t.sales, t.products, t.params.report_start, t.params.report_end)
    ranked = number_rows(cats, [F.desc("Revenue"), F.asc("Category")], "Rank")
    return R.chart_series_json(ranked, "Rank", "Category", "Revenue")
