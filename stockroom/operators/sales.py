"""Sales KPIs, activity feed, paged history and price quotes."""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import (as_date, as_key, before_day_after, discount_pct, discounted, in_month_of, on_day, since_days_before,
                         subtotal, ts_lit, whole_number, with_month_pruning)
from ..session import cut_lineage
from .scan import CHUNK, range_chunked
from .stock import levels
from .topk import top_k_named


def _kpi_windows(as_of: _dt.date):
    return {
        "Today": on_day("SaleDate", as_of),
        "Week": since_days_before("SaleDate", as_of, P.TRAILING_DAYS),
        "Month": in_month_of("SaleDate", as_of),
    }


def sales_kpis(sales: DataFrame, as_of: _dt.date) -> DataFrame:
    """Count and total for today, the trailing 7 days and this month, in one scan.

    Sales are first sliced to ``SaleDate < as_of + 1 day`` (sales cannot be in
    the future at ``as_of``) and to the earliest window start, so the scan
    reads only the needed range.  A NULL total (no sales) is reported as 0.
    """
    earliest = min(as_of.replace(day=1), as_of - _dt.timedelta(days=P.TRAILING_DAYS))
    sliced = with_month_pruning(sales, earliest, as_of) \
        .where(before_day_after("SaleDate", as_of) & (F.col("SaleDate") >= ts_lit(earliest)))
    aggs = []
    for name, cond in _kpi_windows(as_of).items():
        aggs.append(F.count_if(cond).alias(f"{name}Count"))
        aggs.append(F.coalesce(F.sum(F.when(cond, F.col("TotalAmount"))), F.lit(0)).alias(f"{name}Total"))
    return sliced.agg(*aggs)


def sales_window_kpi(sales: DataFrame, as_of: _dt.date, window: str) -> DataFrame:
    """One of the three KPI windows ("Today", "Week", "Month") as (SalesCount, SalesTotal)."""
    k = sales_kpis(sales, as_of)
    return k.select(F.col(f"{window}Count").alias("SalesCount"), F.col(f"{window}Total").alias("SalesTotal"))


def row_count(df: DataFrame, alias: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(alias))


def recent_activity(sales: DataFrame, stock: DataFrame, per_kind: int = P.FEED_BRANCH,
                    k: int = P.FEED_SIZE) -> DataFrame:
    """Activity feed: newest 3 sales and newest 3 receipts, merged (equal rows once), newest 5.

    Each branch is a top-k (``TakeOrderedAndProject``), so only 3 rows per
    branch leave the scan.  Ties on the timestamp are broken by the text.
    """
    sold = sales.select(
        F.lit("Sale").alias("ActivityType"), F.col("SaleDate").alias("ActivityDate"),
        F.concat(F.lit("Sold "), F.col("QuantitySold").cast("string"), F.lit(" of product #"),
                 F.col("ProductID").cast("string")).alias("Details"))
    added = stock.select(
        F.lit("Stock").alias("ActivityType"), F.col("DateAdded").alias("ActivityDate"),
        F.concat(F.lit("Added "), F.col("QuantityAdded").cast("string"), F.lit(" to product #"),
                 F.col("ProductID").cast("string")).alias("Details"))
    top = [b.orderBy(F.desc("ActivityDate"), "Details").limit(per_kind) for b in (sold, added)]
    return (top[0].union(top[1]).distinct()
            .orderBy(F.desc("ActivityDate"), "ActivityType", "Details").limit(k)
            .withColumn("DateText", F.date_format("ActivityDate", P.LABEL_FEED)))


def _history_sales(sales: DataFrame, date_from=None, date_to=None, product=None) -> DataFrame:
    date_from, date_to = as_date(date_from), as_date(date_to)
    s = with_month_pruning(sales, date_from, date_to)
    for c in _history_filter(date_from, date_to, product):
        s = s.where(c)
    return s


def _history_filter(date_from=None, date_to=None, product=None):
    conds = []
    if date_from is not None:
        conds.append(F.col("SaleDate") >= ts_lit(date_from))
    if date_to is not None:
        conds.append(F.col("SaleDate") <= ts_lit(date_to, "23:59:59"))
    key = as_key(product)
    if key is not None:
        conds.append(F.col("ProductID") == F.lit(key))
    return conds


def sales_history_rows(sales: DataFrame, products: DataFrame, users: DataFrame,
                       date_from=None, date_to=None, product=None) -> DataFrame:
    """Sales with product name, user name and today's unit price, optional filters applied.

    Filters are the optional form fields, dates as such or as form text; an empty value or "0" means
    absent (PHP truthiness), and so does a date that is none.  They are applied to ``sales`` before the joins, so they
    reach the parquet scan.
    """
    return _attach_names(_history_sales(sales, date_from, date_to, product), products, users)


_HISTORY_COLUMNS = ["SaleID", "ProductID", "QuantitySold", "SaleDate", "TotalAmount", "UserID",
                    "ProductName", "Username", "UnitPrice"]


def _names(products: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    return {"ProductID": products.select("ProductID", F.col("Name").alias("ProductName"),
                                         F.col("Price").alias("UnitPrice")),
            "UserID": users.select("UserID", "Username")}


def _attach_names(s: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    for key, table in _names(products, users).items():
        s = s.join(table, key)
    return s.select(_HISTORY_COLUMNS)


def sales_history(sales: DataFrame, products: DataFrame, users: DataFrame, page: int = 1,
                  date_from=None, date_to=None, product=None, page_size: int = P.PAGE_SIZE) -> DataFrame:
    """One page of the sales history, newest first (ties: higher SaleID first).

    Pages below 1 are clamped to 1.  The page is cut from the newest ``page * page_size`` sales of
    known products and users before their names are joined; it costs more the
    deeper it lies, so a long walk should use ``sales_history_after``.
    """
    page = max(int(page), 1)
    order = [F.desc("SaleDate"), F.desc("SaleID")]
    s = _history_sales(sales, date_from, date_to, product)
    rows = top_k_named(s, order, page * page_size, _names(products, users)).select(_HISTORY_COLUMNS)
    return (rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
            .withColumn("SaleDateText", F.date_format("SaleDate", P.LABEL_DATETIME)))


class PageIndex(NamedTuple):
    """Order statistics of a history: its rows dealt by ranges of (date, id), newest first, and each range's count."""

    ranges: DataFrame     # the history's sales with their range, checkpointed
    counts: DataFrame     # range, rows, and rows in newer ranges


RANGE = "_range"


def page_index(sales: DataFrame, products: DataFrame, users: DataFrame, date_from=None, date_to=None, product=None,
               ranges: int | None = None) -> PageIndex:
    """Build the index of a (filtered) history once; ``page_of`` then opens only the ranges that hold a page."""
    s = _history_sales(sales, date_from, date_to, product)
    for key, names in _names(products, users).items():
        s = s.join(names.select(key), key, "left_semi")
    dealt = range_chunked(s, [], [F.desc("SaleDate"), F.desc("SaleID")], ranges).withColumnRenamed(CHUNK, RANGE)
    counts = dealt.groupBy(RANGE).agg(F.count("*").alias("rows"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    return PageIndex(dealt, cut_lineage(counts.withColumn("newer", F.coalesce(F.sum("rows").over(before), F.lit(0)))))


def page_of(index: PageIndex, products: DataFrame, users: DataFrame, page: int = 1, page_size: int = P.PAGE_SIZE) -> DataFrame:
    """A page of the indexed history, as ``sales_history`` gives it: its ranges are found from their counts, and
    no other rows are sorted, however deep the page lies."""
    first = (max(int(page), 1) - 1) * page_size
    hit = index.counts.where((F.col("newer") < first + page_size) & (F.col("newer") + F.col("rows") > first)).collect()
    order = [F.desc("SaleDate"), F.desc("SaleID")]
    rows = index.ranges.where(F.col(RANGE).isin([r[RANGE] for r in hit])).drop(RANGE)
    skip = first - min((r["newer"] for r in hit), default=first)
    rows = rows.orderBy(*order).offset(skip).limit(page_size)
    return (_attach_names(rows, products, users).orderBy(*order)
            .withColumn("SaleDateText", F.date_format("SaleDate", P.LABEL_DATETIME)))


def sales_history_after(sales: DataFrame, products: DataFrame, users: DataFrame, last_seen_date,
                        last_seen_id: int, date_from=None, date_to=None, product=None,
                        page_size: int = P.PAGE_SIZE) -> DataFrame:
    """The next history page after the last row shown (keyset paging, newest first).

    Rows strictly older than (``last_seen_date``, ``last_seen_id``) in the
    (SaleDate desc, SaleID desc) order; unlike an offset, the cost does not
    grow with the page number.
    """
    order = [F.desc("SaleDate"), F.desc("SaleID")]
    seen = ts_lit(last_seen_date)
    s = _history_sales(sales, date_from, date_to, product).where(
        (F.col("SaleDate") < seen) | ((F.col("SaleDate") == seen) & (F.col("SaleID") < last_seen_id)))
    return (top_k_named(s, order, page_size, _names(products, users)).select(_HISTORY_COLUMNS)
            .orderBy(*order))


def sales_page_count(sales: DataFrame, products: DataFrame | None = None, users: DataFrame | None = None,
                     filtered: bool = False, date_from=None, date_to=None, product=None,
                     page_size: int = P.PAGE_SIZE) -> DataFrame:
    """Number of history pages, ``ceil(count / page_size)``.

    ``filtered=False`` is the application's behaviour: it counts every sale,
    ignoring the filters.  ``filtered=True`` counts the rows the filtered,
    joined history really has.
    """
    rows = (sales_history_rows(sales, products, users, date_from, date_to, product)
            if filtered else sales)
    return rows.agg(F.ceil(F.count(F.lit(1)) / F.lit(page_size)).cast("bigint").alias("PageCount"))


def price_quote(requests: DataFrame, products: DataFrame, stock: DataFrame, sales: DataFrame) -> DataFrame:
    """Subtotal, discount and final amount for sale requests, with a stock-exceeded flag.

    ``final = price*qty - price*qty*discount/100``; a missing or non-numeric
    discount counts as 0 and no 0..100 range check is applied.  Amounts are
    exact decimals rounded half-up to cents at the end.  Only requests with a
    whole positive quantity for an existing product get a quote; an amount
    that is too large for its column is NULL, and so is what follows from it.
    """
    r = (requests.select("request_id", "ProductID", "Quantity", "Discount")
         .withColumn("Qty", whole_number("Quantity"))
         .where(F.col("Qty") > 0))
    lv = levels(stock, sales, r.select("ProductID").distinct())
    avail = lv.select("ProductID", (F.coalesce("TotalAdded", F.lit(0)) - F.coalesce("TotalSold", F.lit(0)))
                      .alias("Available"))
    q = (r.join(products.select("ProductID", F.col("Price").alias("UnitPrice")), "ProductID")
         .join(avail, "ProductID", "left")
         .withColumn("Subtotal", subtotal("UnitPrice", "Qty"))
         .withColumn("DiscountPct", discount_pct("Discount")))
    return q.select(
        "request_id", "ProductID", F.col("Qty").alias("Quantity"), "UnitPrice", "Subtotal", "DiscountPct",
        discounted(F.col("Subtotal"), F.col("DiscountPct"), "decimal(18,2)").alias("FinalAmount"),
        (F.col("Qty") > F.coalesce(F.col("Available"), F.lit(0))).alias("ExceedsStock"))



def js_parse_int(c) -> F.Column:
    """JavaScript ``parseInt(x) || 0``: leading whole number after whitespace, else 0."""
    lead = F.regexp_extract(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")),
                                             "^\\s+", ""), "^[+-]?[0-9]+", 0)
    return F.coalesce(F.nullif(lead, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def price_preview(requests: DataFrame, products: DataFrame, stock: DataFrame, sales: DataFrame) -> DataFrame:
    """The sale form's live preview: whole-number quantity and discount (fractions cut off).

    Differs from ``price_quote`` (the recorded amount) only when the discount
    text has a fraction.  Every request for an existing product gets a
    preview; ``Blocked`` is the form's stock warning (quantity over net stock).
    """
    lv = levels(stock, sales, requests.select("ProductID").distinct())
    avail = lv.select("ProductID", (F.coalesce("TotalAdded", F.lit(0)) - F.coalesce("TotalSold", F.lit(0)))
                      .alias("Available"))
    q = (requests.select("request_id", "ProductID", js_parse_int("Quantity").alias("Qty"),
                         js_parse_int("Discount").alias("Disc"))
         .join(products.select("ProductID", F.col("Price").alias("UnitPrice")), "ProductID")
         .join(avail, "ProductID", "left")
         .withColumn("Subtotal", subtotal("UnitPrice", "Qty")))
    disc_amt = F.col("Subtotal") * F.col("Disc") * F.lit(Decimal("0.01"))
    return q.select("request_id", "ProductID", F.col("Qty").alias("Quantity"), "Subtotal",
                    F.col("Disc").alias("DiscountPct"),
                    F.round(disc_amt, 2).try_cast("decimal(18,2)").alias("DiscountAmount"),
                    F.round(F.col("Subtotal") - disc_amt, 2).try_cast("decimal(18,2)").alias("FinalAmount"),
                    (F.col("Qty") > F.coalesce(F.col("Available"), F.lit(0))).alias("Blocked"))
