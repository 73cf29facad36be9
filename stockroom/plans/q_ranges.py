"""Registered report queries that are answered from stored sums and sets of sales."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import range_sums as RS
from ..operators import sequential as Q
from ..operators import sold_sets as SS
from ..session import cut_lineage
from .q_sequential import FOLD, RECORDED
from .registry import query

# Fixed run parameters of the long report range.
_LONG = "SaleDate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '2001-12-31 23:59:59'"
# The sales of deleted products (category PROMO) are gone.
_KEPT = """
kept AS (SELECT * FROM sales s WHERE NOT EXISTS (
  SELECT 1 FROM products p WHERE p.ProductID = s.ProductID AND p.Category = 'PROMO'))
"""


def _gone(t):
    return t.sales.join(t.products.where("Category = 'PROMO'").select("ProductID"), "ProductID", "left_semi")


@query("report_totals_stored", f"""
SELECT COALESCE(SUM(TotalAmount), 0) AS TotalRevenue, CAST(COALESCE(SUM(QuantitySold), 0) AS BIGINT) AS TotalItems,
       2557 AS Days, ROUND(CAST(COALESCE(SUM(TotalAmount), 0) AS DOUBLE) / 2557.0, 4) AS DailyAverage
FROM (SELECT SaleDate, TotalAmount, QuantitySold FROM kept
      UNION ALL SELECT SaleDate, TotalAmount, QuantitySold FROM ({RECORDED}) r) x
WHERE {_LONG}
""", extra_ctes=f"{FOLD.strip()}, {_KEPT}", recursive=True)
def q_report_totals_stored(t):
    """Totals of 1995-2001 from stored sums into which recorded sales were folded and out of which deleted products' were."""
    late = cut_lineage(Q.record_sales(t.products, t.stock, t.sales, t.sale_requests).sales)
    tree = RS.fold_sums(cut_lineage(RS.sum_tree(t.sales)), late, _gone(t))
    return RS.totals_of(cut_lineage(tree), t.params.long_start, t.params.long_end)


@query("daily_sales_stored", f"""
SELECT CAST(SaleDate AS DATE) AS SaleDay, SUM(TotalAmount) AS DailyTotal
FROM kept WHERE {_LONG} GROUP BY CAST(SaleDate AS DATE)
""", extra_ctes=_KEPT)
def q_daily_sales_stored(t):
    """Revenue per selling day of 1995-2001 from stored sums, after the sales of deleted products left them."""
    tree = RS.fold_sums(cut_lineage(RS.sum_tree(t.sales)), removed=_gone(t))
    return RS.daily_of(tree, t.params.long_start, t.params.long_end)


@query("sales_trend_stored", """
SELECT Point, FirstDay, LastDay,
       CASE WHEN FirstDay = LastDay THEN strftime(FirstDay, '%b %d')
            ELSE strftime(FirstDay, '%b %d') || ' - ' || strftime(LastDay, '%b %d') END AS Label,
       Value
FROM (SELECT CAST(FLOOR((rn - 1) / CEIL(n / 10.0)) AS INTEGER) AS Point, MIN(SaleDay) AS FirstDay, MAX(SaleDay) AS LastDay,
             SUM(DailyTotal) AS Value
      FROM (SELECT *, row_number() OVER (ORDER BY SaleDay) AS rn, COUNT(*) OVER () AS n FROM days) d GROUP BY 1) p
""", extra_ctes=f"""days AS (SELECT CAST(SaleDate AS DATE) AS SaleDay, SUM(TotalAmount) AS DailyTotal
                             FROM sales WHERE {_LONG} GROUP BY 1)""")
def q_sales_trend_stored(t):
    """At most 10 chart points of 1995-2001 from stored sums: only years and months across a point's end are opened."""
    return RS.trend_of(cut_lineage(RS.sum_tree(t.sales)), t.params.long_start, t.params.long_end)


_RANGES = [(_dt.date(2000, 6, 1), _dt.date(2000, 6, 15)), (_dt.date(1996, 3, 10), _dt.date(1999, 8, 20)),
           (_dt.date(1995, 1, 1), _dt.date(2001, 12, 31))]


@query("top_suppliers_stored", """
SELECT Report, SupplierID, Name AS SupplierName, ProductCount, TotalSupplied
FROM (SELECT Report, SupplierID, COUNT(DISTINCT ProductID) AS ProductCount, CAST(SUM(QuantityAdded) AS BIGINT) AS TotalSupplied
      FROM stock NATURAL JOIN (SELECT DISTINCT Report, ProductID FROM sales, spans
                               WHERE SaleDate >= a AND SaleDate <= b + INTERVAL 86399 SECOND) sold
      GROUP BY Report, SupplierID) x NATURAL JOIN suppliers
QUALIFY row_number() OVER (PARTITION BY Report ORDER BY TotalSupplied DESC, SupplierID) <= 5
""", extra_ctes="spans AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, DATE '{a}', DATE '{b}')" for i, (a, b) in enumerate(_RANGES)) + ") v(Report, a, b))")
def q_top_suppliers_stored(t):
    """The supplier ranking (each receipt once) of three ranges, what was sold taken from stored bitmaps of months and years."""
    sets = cut_lineage(SS.sold_sets(t.sales))
    reports = [SS.top_suppliers_stored(t.suppliers, t.stock, t.sales, sets, a, b).select(F.lit(i).alias("Report"), "*")
               for i, (a, b) in enumerate(_RANGES)]
    return reduce(DataFrame.unionAll, reports)
