"""Registered sales and report queries."""

from __future__ import annotations

from ..functions import report_range
from ..operators import reports as R
from ..operators import sales as S
from .oracle import amount, percent, whole
from .registry import query

# Oracle fragments with the fixed run parameters (as_of 2000-06-15, report
# range 2000-06-01 .. 2000-06-15, long range 1995-01-01 .. 2001-12-31).
_RANGE = "SaleDate BETWEEN TIMESTAMP '2000-06-01 00:00:00' AND TIMESTAMP '2000-06-15 23:59:59'"
_LONG = "SaleDate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '2001-12-31 23:59:59'"
_ASOF_SLICE = "SaleDate < TIMESTAMP '2000-06-16 00:00:00'"
_TODAY = "SaleDate >= TIMESTAMP '2000-06-15 00:00:00' AND SaleDate < TIMESTAMP '2000-06-16 00:00:00'"
_WEEK = "SaleDate >= TIMESTAMP '2000-06-08 00:00:00'"
_MONTH = "SaleDate >= TIMESTAMP '2000-06-01 00:00:00' AND SaleDate < TIMESTAMP '2000-07-01 00:00:00'"


def _kpi_sql(cond: str) -> str:
    return (f"SELECT COUNT(*) AS SalesCount, COALESCE(SUM(TotalAmount), 0) AS SalesTotal "
            f"FROM sales WHERE {_ASOF_SLICE} AND {cond}")


@query("sales_today", _kpi_sql(_TODAY))
def q_sales_today(t):
    """Count and total of sales on the as-of day."""
    return S.sales_window_kpi(t.sales, t.params.as_of, "Today")


@query("sales_week", _kpi_sql(_WEEK))
def q_sales_week(t):
    """Count and total of sales from as_of - 7 days up to as_of."""
    return S.sales_window_kpi(t.sales, t.params.as_of, "Week")


@query("sales_month", _kpi_sql(_MONTH))
def q_sales_month(t):
    """Count and total of sales in the as-of month (up to as_of)."""
    return S.sales_window_kpi(t.sales, t.params.as_of, "Month")


@query("sales_kpis", f"""
SELECT COUNT(*) FILTER (WHERE {_TODAY}) AS TodayCount,
       COALESCE(SUM(TotalAmount) FILTER (WHERE {_TODAY}), 0) AS TodayTotal,
       COUNT(*) FILTER (WHERE {_WEEK}) AS WeekCount,
       COALESCE(SUM(TotalAmount) FILTER (WHERE {_WEEK}), 0) AS WeekTotal,
       COUNT(*) FILTER (WHERE {_MONTH}) AS MonthCount,
       COALESCE(SUM(TotalAmount) FILTER (WHERE {_MONTH}), 0) AS MonthTotal
FROM sales WHERE {_ASOF_SLICE}
""")
def q_sales_kpis(t):
    """Today / trailing-week / month counts and totals from a single scan."""
    return S.sales_kpis(t.sales, t.params.as_of)


@query("product_count", "SELECT COUNT(*) AS ProductCount FROM products")
def q_product_count(t):
    """Number of products."""
    return S.row_count(t.products, "ProductCount")


@query("sales_count", "SELECT COUNT(*) AS SalesCount FROM sales")
def q_sales_count(t):
    """Number of sales."""
    return S.row_count(t.sales, "SalesCount")


@query("recent_activity", """
SELECT ActivityType, ActivityDate, Details, strftime(ActivityDate, '%m/%d/%Y %H:%M') AS DateText
FROM (SELECT DISTINCT ActivityType, ActivityDate, Details FROM (
        SELECT *, row_number() OVER (PARTITION BY ActivityType ORDER BY ActivityDate DESC, Details) AS place FROM (
          SELECT 'Sale' AS ActivityType, SaleDate AS ActivityDate,
                 format('Sold {} of product #{}', QuantitySold, ProductID) AS Details FROM sales
          UNION ALL
          SELECT 'Stock', DateAdded, format('Added {} to product #{}', QuantityAdded, ProductID) FROM stock) e) p
      WHERE place <= 3) f
QUALIFY row_number() OVER (ORDER BY ActivityDate DESC, ActivityType, Details) <= 5
""")
def q_recent_activity(t):
    """Newest 3 sales and newest 3 receipts merged into a 5-line feed."""
    return S.recent_activity(t.sales, t.stock)


_HISTORY = """
SELECT s.SaleID, s.ProductID, s.QuantitySold, s.SaleDate, s.TotalAmount, s.UserID,
       p.Name AS ProductName, u.Username, p.Price AS UnitPrice
FROM sales s JOIN products p ON s.ProductID = p.ProductID JOIN users u ON s.UserID = u.UserID
WHERE s.SaleDate >= TIMESTAMP '2000-06-01 00:00:00' AND s.SaleDate <= TIMESTAMP '2000-06-15 23:59:59'
"""


@query("sales_history", f"""
SELECT *, strftime(SaleDate, '%b %d, %Y %H:%M') AS SaleDateText FROM ({_HISTORY}) h
ORDER BY SaleDate DESC, SaleID DESC LIMIT 10 OFFSET 10
""")
def q_sales_history(t):
    """Page 2 of the sales history filtered to the report range, newest first."""
    p = t.params
    return S.sales_history(t.sales, t.products, t.users, page=p.history_page,
                           date_from=p.report_start, date_to=p.report_end)


@query("sales_history_form", f"""
SELECT *, strftime(SaleDate, '%b %d, %Y %H:%M') AS SaleDateText FROM ({_HISTORY}) h
WHERE ProductID = 7
ORDER BY SaleDate DESC, SaleID DESC LIMIT 10
""")
def q_sales_history_form(t):
    """Page 1 of the history with every filter given as form text."""
    return S.sales_history(t.sales, t.products, t.users, page=0, date_from="2000-06-01", date_to="2000-06-15",
                           product="7")


@query("sales_history_deep", """
SELECT *, strftime(SaleDate, '%b %d, %Y %H:%M') AS SaleDateText FROM (
  SELECT s.SaleID, s.ProductID, s.QuantitySold, s.SaleDate, s.TotalAmount, s.UserID,
         p.Name AS ProductName, u.Username, p.Price AS UnitPrice
  FROM sales s JOIN products p ON s.ProductID = p.ProductID JOIN users u ON s.UserID = u.UserID) h
ORDER BY SaleDate DESC, SaleID DESC LIMIT 10 OFFSET 1990
""")
def q_sales_history_deep(t):
    """Page 200 of the whole history by order statistics: only the ranges that hold it are opened."""
    return S.page_of(S.page_index(t.sales, t.products, t.users), t.products, t.users, page=200)


@query("sales_page_count", "SELECT CAST(CEIL(COUNT(*) / 10) AS BIGINT) AS PageCount FROM sales")
def q_sales_page_count(t):
    """History page count as the application computes it (ignores the filters)."""
    return S.sales_page_count(t.sales)


@query("sales_page_count_filtered", f"SELECT CAST(CEIL(COUNT(*) / 10) AS BIGINT) AS PageCount FROM ({_HISTORY}) h")
def q_sales_page_count_filtered(t):
    """History page count over the filtered, joined rows (corrected count)."""
    p = t.params
    return S.sales_page_count(t.sales, t.products, t.users, filtered=True,
                              date_from=p.report_start, date_to=p.report_end)


@query("price_quote", f"""
SELECT r.request_id, r.ProductID, r.Qty AS Quantity, p.Price AS UnitPrice,
       TRY_CAST(p.Price * r.Qty AS DECIMAL(18,2)) AS Subtotal, r.DiscountPct,
       {amount('p.Price', 'r.Qty', 'r.DiscountPct', 18)} AS FinalAmount,
       r.Qty > COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) AS ExceedsStock
FROM (SELECT request_id, ProductID, {whole('Quantity')} AS Qty, {percent('Discount')} AS DiscountPct
      FROM sale_requests) r
JOIN products p ON r.ProductID = p.ProductID
LEFT JOIN (SELECT ProductID, SUM(QuantityAdded) AS TotalAdded FROM stock GROUP BY ProductID) a ON r.ProductID = a.ProductID
LEFT JOIN (SELECT ProductID, SUM(QuantitySold) AS TotalSold FROM sales GROUP BY ProductID) s ON r.ProductID = s.ProductID
WHERE r.Qty > 0
""")
def q_price_quote(t):
    """Subtotal / discount / final amount for each valid sale request, with a stock flag."""
    return S.price_quote(t.sale_requests, t.products, t.stock, t.sales)


# ---- reports ---------------------------------------------------------------
@query("report_totals", f"""
SELECT COALESCE(SUM(TotalAmount), 0) AS TotalRevenue, CAST(COALESCE(SUM(QuantitySold), 0) AS BIGINT) AS TotalItems,
       15 AS Days, ROUND(CAST(COALESCE(SUM(TotalAmount), 0) AS DOUBLE) / 15.0, 4) AS DailyAverage
FROM sales WHERE {_RANGE}
""")
def q_report_totals(t):
    """Revenue, units and daily average over the report range."""
    return R.report_totals(t.sales, t.params.report_start, t.params.report_end)


@query("report_totals_default", f"""
SELECT COALESCE(SUM(TotalAmount), 0) AS TotalRevenue, CAST(COALESCE(SUM(QuantitySold), 0) AS BIGINT) AS TotalItems,
       15 AS Days, ROUND(CAST(COALESCE(SUM(TotalAmount), 0) AS DOUBLE) / 15.0, 4) AS DailyAverage
FROM sales WHERE {_RANGE}
""")
def q_report_totals_default(t):
    """Totals over the range that a report has when none is asked for: the as-of month up to as_of."""
    return R.report_totals(t.sales, *report_range(t.params.as_of))


@query("top_products_by_quantity", """
SELECT x.ProductID, p.Name, x.TotalQuantity, x.TotalRevenue
FROM (SELECT ProductID, CAST(SUM(QuantitySold) AS BIGINT) AS TotalQuantity, SUM(TotalAmount) AS TotalRevenue
      FROM sales GROUP BY ProductID) x JOIN products p ON x.ProductID = p.ProductID
ORDER BY x.TotalQuantity DESC, x.ProductID LIMIT 5
""")
def q_top_products_by_quantity(t):
    """Five best-selling products by units over all sales."""
    return R.top_products_by_quantity(t.sales, t.products)


@query("top_products_by_revenue", f"""
SELECT p.ProductID, p.Name, CAST(SUM(s.QuantitySold) AS BIGINT) AS TotalSold, SUM(s.TotalAmount) AS Revenue,
       ROUND(CAST(SUM(s.TotalAmount) AS DOUBLE)
             / NULLIF((SELECT CAST(SUM(TotalAmount) AS DOUBLE) FROM sales WHERE {_RANGE}), 0) * 100, 4) AS Percentage
FROM sales s JOIN products p ON s.ProductID = p.ProductID
WHERE s.{_RANGE}
GROUP BY p.ProductID, p.Name
ORDER BY Revenue DESC, p.ProductID LIMIT 5
""")
def q_top_products_by_revenue(t):
    """Five products with the highest revenue in the report range and their share."""
    return R.top_products_by_revenue(t.sales, t.products, t.params.report_start, t.params.report_end)


# A receipt counts once for each sale of its product in the range.
_MOVED = """
hits AS (SELECT ProductID, COUNT(*) AS n FROM sales WHERE {rng} GROUP BY ProductID),
moved AS (SELECT SupplierID, COUNT(DISTINCT ProductID) AS ProductCount,
                 CAST(SUM(QuantityAdded * n) AS BIGINT) AS TotalSupplied
          FROM stock NATURAL JOIN hits GROUP BY SupplierID)
"""
_TOP_SUPPLIERS = """
SELECT SupplierID, Name AS SupplierName, ProductCount, TotalSupplied FROM moved NATURAL JOIN suppliers
QUALIFY row_number() OVER (ORDER BY TotalSupplied DESC, SupplierID) <= 5
"""


@query("top_suppliers", _TOP_SUPPLIERS, extra_ctes=_MOVED.format(rng=_RANGE))
def q_top_suppliers(t):
    """Five suppliers with the most units supplied for products sold in the range (fan-out figure)."""
    return R.top_suppliers(t.suppliers, t.stock, t.sales, t.params.report_start, t.params.report_end)


@query("top_suppliers_long_range", _TOP_SUPPLIERS, extra_ctes=_MOVED.format(rng=_LONG))
def q_top_suppliers_long_range(t):
    """The fan-out supplier ranking over the whole 1995-2001 range."""
    return R.top_suppliers(t.suppliers, t.stock, t.sales, t.params.long_start, t.params.long_end)


@query("top_suppliers_unfanned", f"""
SELECT sup.SupplierID, sup.Name AS SupplierName, COUNT(DISTINCT st.ProductID) AS ProductCount,
       CAST(SUM(st.QuantityAdded) AS BIGINT) AS TotalSupplied
FROM suppliers sup JOIN stock st ON sup.SupplierID = st.SupplierID
WHERE st.ProductID IN (SELECT ProductID FROM sales WHERE {_RANGE})
GROUP BY sup.SupplierID, sup.Name
ORDER BY TotalSupplied DESC, sup.SupplierID LIMIT 5
""")
def q_top_suppliers_unfanned(t):
    """Supplier ranking counting each receipt once (our correction of the fan-out)."""
    return R.top_suppliers(t.suppliers, t.stock, t.sales, t.params.report_start, t.params.report_end,
                           fanned=False)


@query("category_breakdown", f"""
SELECT p.Category, SUM(s.TotalAmount) AS Revenue
FROM sales s JOIN products p ON s.ProductID = p.ProductID
WHERE s.{_RANGE} GROUP BY p.Category
""")
def q_category_breakdown(t):
    """Revenue per category in the report range."""
    return R.category_breakdown(t.sales, t.products, t.params.report_start, t.params.report_end)


@query("daily_sales", f"""
SELECT CAST(SaleDate AS DATE) AS SaleDay, SUM(TotalAmount) AS DailyTotal
FROM sales WHERE {_RANGE} GROUP BY CAST(SaleDate AS DATE)
""")
def q_daily_sales(t):
    """Revenue per selling day in the report range."""
    return R.daily_sales(t.sales, t.params.report_start, t.params.report_end)


@query("daily_sales_dense_7d", """
SELECT g.Position, g.SaleDay, strftime(g.SaleDay, '%b %d') AS Label,
       CAST(COALESCE(d.Total, 0) AS DECIMAL(24,2)) AS Total
FROM (SELECT CAST(i AS INTEGER) AS Position, CAST(DATE '2000-06-15' - CAST(6 - i AS INTEGER) AS DATE) AS SaleDay
      FROM range(7) r(i)) g
LEFT JOIN (SELECT CAST(SaleDate AS DATE) AS SaleDay, SUM(TotalAmount) AS Total FROM sales
           WHERE SaleDate >= TIMESTAMP '2000-06-09 00:00:00' AND SaleDate < TIMESTAMP '2000-06-16 00:00:00'
           GROUP BY 1) d ON g.SaleDay = d.SaleDay
""")
def q_daily_sales_dense_7d(t):
    """Last 7 days of revenue up to as_of, one point per day, 0 where no sales."""
    return R.daily_sales_dense(t.sales, t.params.as_of)


_TREND = f"""
days AS (SELECT CAST(SaleDate AS DATE) AS SaleDay, SUM(TotalAmount) AS DailyTotal
         FROM sales WHERE {_LONG} GROUP BY 1),
numbered AS (SELECT SaleDay, DailyTotal, row_number() OVER (ORDER BY SaleDay) AS rn,
                    COUNT(*) OVER () AS n FROM days),
points AS (SELECT CAST(FLOOR((rn - 1) / CEIL(n / 10.0)) AS INTEGER) AS Point,
                  MIN(SaleDay) AS FirstDay, MAX(SaleDay) AS LastDay, SUM(DailyTotal) AS Value
           FROM numbered GROUP BY 1)
"""


@query("sales_trend_binned", """
SELECT Point, FirstDay, LastDay,
       CASE WHEN FirstDay = LastDay THEN strftime(FirstDay, '%b %d')
            ELSE strftime(FirstDay, '%b %d') || ' - ' || strftime(LastDay, '%b %d') END AS Label,
       Value
FROM points
""", extra_ctes=_TREND)
def q_sales_trend_binned(t):
    """Daily revenue over 1995-2001 reduced to at most 10 chart points."""
    return R.sales_trend_binned(t.sales, t.params.long_start, t.params.long_end)


@query("price_preview", """
SELECT r.request_id, r.ProductID, r.Qty AS Quantity, TRY_CAST(p.Price * r.Qty AS DECIMAL(18,2)) AS Subtotal,
       r.Disc AS DiscountPct,
       TRY_CAST(ROUND(TRY_CAST(p.Price * r.Qty AS DECIMAL(18,2)) * r.Disc * 0.01, 2) AS DECIMAL(18,2)) AS DiscountAmount,
       TRY_CAST(ROUND(TRY_CAST(p.Price * r.Qty AS DECIMAL(18,2))
                  - TRY_CAST(p.Price * r.Qty AS DECIMAL(18,2)) * r.Disc * 0.01, 2) AS DECIMAL(18,2)) AS FinalAmount,
       r.Qty > COALESCE(a.TotalAdded, 0) - COALESCE(s.TotalSold, 0) AS Blocked
FROM (SELECT request_id, ProductID,
             COALESCE(TRY_CAST(NULLIF(regexp_extract(ltrim(COALESCE(Quantity, '')), '^[+-]?[0-9]+', 0), '')
                               AS BIGINT), 0) AS Qty,
             COALESCE(TRY_CAST(NULLIF(regexp_extract(ltrim(COALESCE(Discount, '')), '^[+-]?[0-9]+', 0), '')
                               AS BIGINT), 0) AS Disc
      FROM sale_requests) r
JOIN products p ON r.ProductID = p.ProductID
LEFT JOIN (SELECT ProductID, SUM(QuantityAdded) AS TotalAdded FROM stock GROUP BY ProductID) a ON r.ProductID = a.ProductID
LEFT JOIN (SELECT ProductID, SUM(QuantitySold) AS TotalSold FROM sales GROUP BY ProductID) s ON r.ProductID = s.ProductID
""")
def q_price_preview(t):
    """The sale form's live total preview for every sale request (whole-number inputs)."""
    return S.price_preview(t.sale_requests, t.products, t.stock, t.sales)


@query("report_totals_text", f"""
SELECT TotalRevenue, TotalItems, Days, DailyAverage,
       '$' || format('{{:,.2f}}', TotalRevenue) AS RevenueText, format('{{:,}}', TotalItems) AS ItemsText,
       'Jun 01 - Jun 15' AS RangeText
FROM (SELECT COALESCE(SUM(TotalAmount), 0) AS TotalRevenue,
             CAST(COALESCE(SUM(QuantitySold), 0) AS BIGINT) AS TotalItems, 15 AS Days,
             ROUND(CAST(COALESCE(SUM(TotalAmount), 0) AS DOUBLE) / 15.0, 4) AS DailyAverage
      FROM sales WHERE {_RANGE}) t
""")
def q_report_totals_text(t):
    """Report summary with display texts ("$1,234.50", "12,345", "Jun 01 - Jun 15")."""
    return R.report_totals_text(t.sales, t.params.report_start, t.params.report_end)


@query("top_products_text", f"""
SELECT *, format('{{:,}}', TotalSold) AS SoldText, '$' || format('{{:,.2f}}', Revenue) AS RevenueText,
       format('{{:.1f}}', ROUND(Percentage, 1)) || '%' AS PercentageText
FROM (SELECT p.ProductID, p.Name, CAST(SUM(s.QuantitySold) AS BIGINT) AS TotalSold, SUM(s.TotalAmount) AS Revenue,
             ROUND(CAST(SUM(s.TotalAmount) AS DOUBLE)
                   / NULLIF((SELECT CAST(SUM(TotalAmount) AS DOUBLE) FROM sales WHERE {_RANGE}), 0) * 100, 4)
               AS Percentage
      FROM sales s JOIN products p ON s.ProductID = p.ProductID
      WHERE s.{_RANGE} GROUP BY p.ProductID, p.Name ORDER BY Revenue DESC, p.ProductID LIMIT 5) x
""")
def q_top_products_text(t):
    """Top products by revenue with display texts (units, money, share with one decimal)."""
    return R.top_products_text(t.sales, t.products, t.params.report_start, t.params.report_end)


@query("sales_history_after", f"""
SELECT * FROM ({_HISTORY}) h
WHERE SaleDate < TIMESTAMP '2000-06-10 00:00:00'
   OR (SaleDate = TIMESTAMP '2000-06-10 00:00:00' AND SaleID < 5000000000000)
ORDER BY SaleDate DESC, SaleID DESC LIMIT 10
""")
def q_sales_history_after(t):
    """The history page after the row (2000-06-10, SaleID 5000000000000), keyset paging in the report range."""
    import datetime as _dt

    p = t.params
    return S.sales_history_after(t.sales, t.products, t.users, _dt.datetime(2000, 6, 10), 5_000_000_000_000,
                                 date_from=p.report_start, date_to=p.report_end)
