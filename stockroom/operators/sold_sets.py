"""Exact sets of the products sold in each calendar month and year, as bitmaps that merge over any range.

A row is (Level, Start, Bucket, Products): the products of one bucket of 32,768 ids that were sold in the month or year, one bit each,
4 KB whatever the number of sales.  A range takes its whole years and months from the stored bitmaps; only the sales of the days
before the first and after the last whole month are read, at most two months of them.  Sales without a date or a product are in no set.

Late sales are ored into their months and years (``fold_sold``).  A bit doesn't know how many sales set it, so where sales are removed or
edited their months are built anew from what is left of these months (``rebuilt``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import closed_range, ts_lit, with_month_pruning
from .range_sums import cover, whole_months
from .topk import top_k_named

COLUMNS = ["Level", "Start", "Bucket", "Products"]


def _bits(products: DataFrame, *by: str) -> DataFrame:
    """Bitmaps of distinct ``ProductID`` rows: distinct first, so that what is shuffled are ids and not bitmaps."""
    named = products.where("ProductID is not null").distinct()
    return named.groupBy(*by, F.bitmap_bucket_number("ProductID").alias("Bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("ProductID")).alias("Products"))


def _months(sales: DataFrame) -> DataFrame:
    month = F.trunc(F.to_date("SaleDate"), "month")
    return _bits(sales.where("SaleDate is not null").select(F.lit("month").alias("Level"), month.alias("Start"), "ProductID"),
                 "Level", "Start").select(*COLUMNS)


def _grown(months: DataFrame) -> DataFrame:
    """Months, one row for each bucket, and the years above them."""
    either = F.bitmap_or_agg("Products").alias("Products")
    months = months.groupBy("Level", "Start", "Bucket").agg(either)
    years = months.groupBy(F.lit("year").alias("Level"), F.trunc("Start", "year").alias("Start"), "Bucket").agg(either)
    return months.select(*COLUMNS).unionAll(years.select(*COLUMNS))


def sold_sets(sales: DataFrame) -> DataFrame:
    """The bitmaps of ``sales``, read once; store them."""
    return _grown(_months(sales))


def fold_sold(sets: DataFrame, added: DataFrame) -> DataFrame:
    """The stored ``sets`` after more sales; only the sets and the batch are read."""
    return _grown(sets.where("Level = 'month'").select(*COLUMNS).unionAll(_months(added)))


def rebuilt(sets: DataFrame, sales: DataFrame, months: list[_dt.date]) -> DataFrame:
    """The stored ``sets`` with the given months (by their first days) built anew from ``sales``, of which only those months are read."""
    if not months:
        return sets
    old = sets.where(F.col("Level") == "month").where(~F.col("Start").isin(months))
    end = max(_dt.date(m.year + m.month // 12, m.month % 12 + 1, 1) for m in months)
    left = with_month_pruning(sales, min(months), end).where(
        (F.col("SaleDate") >= ts_lit(min(months))) & (F.col("SaleDate") < ts_lit(end)))
    return _grown(old.select(*COLUMNS).unionAll(_months(left).where(F.col("Start").isin(months))))


def sold_between(sets: DataFrame, sales: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """(Bucket, Products): the products sold in ``start 00:00:00 .. end 23:59:59``."""
    first, after = whole_months(start, end)
    if first < after:
        edges = [(start, first - _dt.timedelta(days=1)), (after, end)]
        stored = sets.where(cover(start, end))
    else:
        edges, stored = [(start, end)], sets.limit(0)
    for a, b in edges:
        if a > b:
            continue
        # an edge that isn't the range's last day ends with its day, fractions of a second included
        until = closed_range("SaleDate", a, b) if b == end else \
            (F.col("SaleDate") >= ts_lit(a)) & (F.col("SaleDate") < ts_lit(b + _dt.timedelta(days=1)))
        stored = stored.select("Bucket", "Products").unionAll(_bits(with_month_pruning(sales, a, b).where(until).select("ProductID")))
    return stored.groupBy("Bucket").agg(F.bitmap_or_agg("Products").alias("Products"))


def is_in(product: str, bitmap: str) -> F.Column:
    """Whether a product's bit is set in its bucket's bitmap."""
    at = F.bitmap_bit_position(product)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def top_suppliers_stored(suppliers: DataFrame, stock: DataFrame, sales: DataFrame, sets: DataFrame, start: _dt.date,
                         end: _dt.date, k: int = P.TOP_SUPPLIERS) -> DataFrame:
    """``reports.top_suppliers(fanned=False)``, with what was sold taken from the stored sets."""
    received = stock.groupBy("SupplierID", "ProductID").agg(F.sum("QuantityAdded").alias("Received"))
    sold = sold_between(sets, sales, start, end)
    hit = received.withColumn("Bucket", F.bitmap_bucket_number("ProductID")).join(sold, "Bucket").where(is_in("ProductID", "Products"))
    per = hit.groupBy("SupplierID").agg(F.count("*").alias("ProductCount"), F.sum("Received").alias("TotalSupplied"))
    order = [F.desc("TotalSupplied"), F.asc("SupplierID")]
    names = suppliers.select("SupplierID", F.col("Name").alias("SupplierName"))
    out = top_k_named(per, order, k, {"SupplierID": names})
    return out.select("SupplierID", "SupplierName", "ProductCount", "TotalSupplied").orderBy(*order)
