"""Date-range reports and chart series.

All range reports read ``range_sales`` (closed range ``start 00:00:00 ..
end 23:59:59``), a filter that reaches the parquet scan.  Aggregations run
on ``ProductID`` first and join product names / categories afterwards, so
the joins see one row per product instead of one per sale.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import (before_day_after, closed_range, count_text, date_lit, day_label, money_text,
                         percent_text, since_days_before, with_month_pruning)
from ..session import cut_lineage
from .scan import number_rows
from .topk import top_k_named


def range_sales(sales: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """Sales in ``start 00:00:00 .. end 23:59:59`` (pruned by month on the stored layout)."""
    return with_month_pruning(sales, start, end).where(closed_range("SaleDate", start, end))


def report_totals(sales: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """Revenue and units over the range, and revenue per calendar day of the range.

    Days = end - start + 1 (days without sales count); a non-positive day count
    is treated as 1.  NULL sums (no sales) are reported as 0.
    """
    days = max((end - start).days + 1, 1)
    s = range_sales(sales, start, end)
    return (s.agg(F.coalesce(F.sum("TotalAmount"), F.lit(0)).alias("TotalRevenue"),
                  F.coalesce(F.sum("QuantitySold"), F.lit(0)).cast("bigint").alias("TotalItems"))
            .withColumn("Days", F.lit(days))
            .withColumn("DailyAverage", F.round(F.col("TotalRevenue").cast("double") / F.lit(float(days)), 4)))


def top_products_by_quantity(sales: DataFrame, products: DataFrame, k: int = P.TOP_PRODUCTS) -> DataFrame:
    """Top ``k`` products by units sold over all sales (ties: lower ProductID)."""
    per = sales.groupBy("ProductID").agg(F.sum("QuantitySold").alias("TotalQuantity"),
                                         F.sum("TotalAmount").alias("TotalRevenue"))
    order = [F.desc("TotalQuantity"), F.asc("ProductID")]
    names = products.select("ProductID", "Name")
    out = top_k_named(per, order, k, {"ProductID": names})
    return out.select("ProductID", "Name", "TotalQuantity", "TotalRevenue").orderBy(*order)


def top_products_by_revenue(sales: DataFrame, products: DataFrame, start: _dt.date, end: _dt.date,
                            k: int = P.TOP_PRODUCTS) -> DataFrame:
    """Top ``k`` products by revenue in the range, with their share of the range total.

    The range total is a scalar subquery, evaluated once.  A zero total gives
    a NULL share (no division error).
    """
    s = range_sales(sales, start, end)
    total = s.agg(F.sum("TotalAmount").cast("double")).scalar()
    per = s.groupBy("ProductID").agg(F.sum("QuantitySold").alias("TotalSold"),
                                     F.sum("TotalAmount").alias("Revenue"))
    order = [F.desc("Revenue"), F.asc("ProductID")]
    names = products.select("ProductID", "Name")
    out = top_k_named(per, order, k, {"ProductID": names})
    return (out.withColumn("Percentage", F.round(F.try_divide(F.col("Revenue").cast("double"), total) * 100, 4))
            .select("ProductID", "Name", "TotalSold", "Revenue", "Percentage")
            .orderBy(*order))


def _supplier_product_receipts(stock: DataFrame) -> DataFrame:
    return stock.groupBy("SupplierID", "ProductID").agg(F.sum("QuantityAdded").alias("Received"))


def supplier_volume(stock: DataFrame, sales: DataFrame, start: _dt.date, end: _dt.date,
                    fanned: bool = True) -> DataFrame:
    """Per supplier: products sold in the range and units supplied (see ``top_suppliers``)."""
    sold = range_sales(sales, start, end).groupBy("ProductID").agg(F.count(F.lit(1)).alias("SaleRows"))
    pairs = _supplier_product_receipts(stock).join(sold, "ProductID")
    weight = F.col("Received") * F.col("SaleRows") if fanned else F.col("Received")
    return pairs.groupBy("SupplierID").agg(F.count(F.lit(1)).alias("ProductCount"),
                                           F.sum(weight).alias("TotalSupplied"))


def top_suppliers(suppliers: DataFrame, stock: DataFrame, sales: DataFrame, start: _dt.date,
                  end: _dt.date, k: int = P.TOP_SUPPLIERS, fanned: bool = True) -> DataFrame:
    """Top ``k`` suppliers by units supplied, for products sold in the range.

    ``fanned=True`` gives the application's figure: receipts joined to sales
    on the product, so each receipt is counted once per matching sale in the
    range.  It is computed without building that join: receipts are summed per
    (supplier, product), sales are counted per product, and the two small
    results are joined and multiplied.  ``fanned=False`` counts each receipt
    once (products with at least one sale in the range).
    """
    per = supplier_volume(stock, sales, start, end, fanned)
    order = [F.desc("TotalSupplied"), F.asc("SupplierID")]
    names = suppliers.select("SupplierID", F.col("Name").alias("SupplierName"))
    out = top_k_named(per, order, k, {"SupplierID": names})
    return out.select("SupplierID", "SupplierName", "ProductCount", "TotalSupplied").orderBy(*order)


def category_breakdown(sales: DataFrame, products: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """Revenue per product category in the range, highest first."""
    per = range_sales(sales, start, end).groupBy("ProductID").agg(F.sum("TotalAmount").alias("Revenue"))
    return (per.join(products.select("ProductID", "Category"), "ProductID")
            .groupBy("Category").agg(F.sum("Revenue").alias("Revenue"))
            .orderBy(F.desc("Revenue"), "Category"))


def daily_sales(sales: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """Revenue per calendar day in the range; days without sales are absent."""
    return (range_sales(sales, start, end)
            .groupBy(F.to_date("SaleDate").alias("SaleDay"))
            .agg(F.sum("TotalAmount").alias("DailyTotal"))
            .orderBy("SaleDay"))


def daily_sales_dense(sales: DataFrame, as_of: _dt.date, days: int = P.DENSE_SERIES_DAYS) -> DataFrame:
    """Revenue for each of the last ``days`` calendar days up to ``as_of``, 0 where none.

    The day spine has exactly ``days`` rows (built with ``range``) and the
    daily totals at most ``days`` rows, so the join is a broadcast of a
    known-tiny side.
    """
    spark = sales.sparkSession
    spine = spark.range(days).select(
        F.col("id").cast("int").alias("Position"),
        F.date_sub(date_lit(as_of), (F.lit(days - 1) - F.col("id")).cast("int")).alias("SaleDay"))
    s = with_month_pruning(sales, as_of - _dt.timedelta(days=days - 1), as_of) \
        .where(since_days_before("SaleDate", as_of, days - 1) & before_day_after("SaleDate", as_of))
    daily = s.groupBy(F.to_date("SaleDate").alias("SaleDay")).agg(F.sum("TotalAmount").alias("Total"))
    # the per-day totals cover at most `days` calendar days: a proven-small build side
    return (spine.join(F.broadcast(daily), "SaleDay", "left")
            .select("Position", "SaleDay", day_label("SaleDay").alias("Label"),
                    F.coalesce("Total", F.lit(0)).cast("decimal(24,2)").alias("Total"))
            .orderBy("Position"))


def sales_trend_binned(sales: DataFrame, start: _dt.date, end: _dt.date,
                       max_points: int = P.MAX_TREND_POINTS) -> DataFrame:
    """Daily revenue in the range reduced to at most ``max_points`` points.

    With n selling days (days without sales are skipped), consecutive days are
    grouped in chunks of ``ceil(n / max_points)`` and summed; for n <= max_points
    each day is its own point.  Labels are "Mon dd" or "Mon dd - Mon dd".

    Days are numbered over the day-grain frame (one row per selling day, so
    bounded by the range length) with ``scan.number_rows``; n is a scalar
    subquery.
    """
    daily = cut_lineage(range_sales(sales, start, end)
                        .groupBy(F.to_date("SaleDate").alias("SaleDay"))
                        .agg(F.sum("TotalAmount").alias("DailyTotal")))
    n = daily.agg(F.count(F.lit(1))).scalar()
    chunked = (number_rows(daily, ["SaleDay"], "rn")
               .withColumn("Point", F.floor((F.col("rn") - 1) / F.ceil(n / F.lit(max_points))).cast("int")))
    pts = chunked.groupBy("Point").agg(F.min("SaleDay").alias("FirstDay"), F.max("SaleDay").alias("LastDay"),
                                       F.sum("DailyTotal").alias("Value"))
    label = F.when(F.col("FirstDay") == F.col("LastDay"), day_label("FirstDay")) \
        .otherwise(F.concat(day_label("FirstDay"), F.lit(" - "), day_label("LastDay")))
    return pts.select("Point", "FirstDay", "LastDay", label.alias("Label"), "Value").orderBy("Point")


def chart_series_json(points: DataFrame, order_col: str, label_col: str, value_col: str) -> DataFrame:
    """One row with the chart's label and value arrays as JSON text.

    Only for already-reduced series (at most a few dozen points).
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(label_col).alias("l"),
                                                   F.col(value_col).alias("v"))))
    return (points.agg(ordered.alias("pts"))
            .select(F.to_json(F.transform("pts", lambda x: x["l"])).alias("Labels"),
                    F.to_json(F.transform("pts", lambda x: x["v"])).alias("Values")))


def report_totals_text(sales: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """``report_totals`` with the display texts of the summary boxes."""
    return (report_totals(sales, start, end)
            .withColumn("RevenueText", money_text("TotalRevenue"))
            .withColumn("ItemsText", count_text("TotalItems"))
            .withColumn("RangeText", F.concat(day_label(date_lit(start)), F.lit(" - "), day_label(date_lit(end)))))


def top_products_text(sales: DataFrame, products: DataFrame, start: _dt.date, end: _dt.date,
                      k: int = P.TOP_PRODUCTS) -> DataFrame:
    """``top_products_by_revenue`` with the table's display texts."""
    return (top_products_by_revenue(sales, products, start, end, k)
            .withColumn("SoldText", count_text("TotalSold"))
            .withColumn("RevenueText", money_text("Revenue"))
            .withColumn("PercentageText", percent_text(F.round("Percentage", 1))))
