"""Sums of sales by calendar day, month and year, from which the figures of any report range are added up.

A node row is (Level, Start, Parent, FirstDay, LastDay, Days, Sales, Priced, Amount, Items): the first, last and number of selling
days of a day, month or year, its sales, those that have an amount, and the sums of amounts and quantities.  A report's last day ends at 23:59:59, so each
day has a ``cut`` node besides: its sales up to then, a fraction of a second after that left out.  A range is its last day's
``cut`` and the whole years, months and days before it: a few dozen nodes and one for each year, however many sales there are.

Late, deleted and edited sales change their days by their own sums (``fold_sums``); months and years are added up from the stored days
again, never from sales.  Sales without a date are in no range and in no node.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import date_lit, day_label, ts_lit

MONEY = "decimal(28,2)"
_SUMS = {"Days": "long", "Sales": "long", "Priced": "long", "Amount": MONEY, "Items": "long"}
COLUMNS = ["Level", "Start", "Parent", "FirstDay", "LastDay", *_SUMS]
_CHILD = {"year": "month", "month": "day"}


def _day_sums(sales: DataFrame, sign: int = 1) -> DataFrame:
    """Day and cut nodes of ``sales``, or what taking them away does to the nodes."""
    day = F.to_date("SaleDate")
    in_time = (F.date_format("SaleDate", "HH:mm:ss") != "23:59:59") | (F.date_trunc("second", "SaleDate") == F.col("SaleDate"))

    def figures(which: Column | None) -> list[Column]:
        pick = (lambda c: c) if which is None else (lambda c: F.when(which, c))
        one = pick(F.lit(1))
        return [(F.count(one) * sign).alias("Sales"), (F.count(pick(F.col("TotalAmount"))) * sign).alias("Priced"),
                (F.coalesce(F.sum(pick(F.col("TotalAmount"))), F.lit(0)) * sign).cast(MONEY).alias("Amount"),
                (F.coalesce(F.sum(pick(F.col("QuantitySold"))), F.lit(0)) * sign).cast("long").alias("Items")]

    both = sales.where("SaleDate is not null").groupBy(day.alias("Start")).agg(
        F.struct(F.lit("day").alias("Level"), *figures(None)).alias("whole"),
        F.struct(F.lit("cut").alias("Level"), *figures(in_time)).alias("cut"))
    return both.select("Start", F.explode(F.array("whole", "cut")).alias("n")).select("Start", "n.*")


def _grown(days: DataFrame) -> DataFrame:
    """Day and cut nodes with a day count, and the months and years above the days."""
    sums = [F.sum(c).cast(kind).alias(c) for c, kind in _SUMS.items()]
    days = days.withColumn("Days", F.lit(1)).groupBy("Level", "Start").agg(*sums).where("Sales <> 0").select(
        "Level", "Start", F.trunc("Start", "month").alias("Parent"), F.col("Start").alias("FirstDay"),
        F.col("Start").alias("LastDay"), F.lit(1).cast("long").alias("Days"), *[c for c in _SUMS if c != "Days"])
    up = [F.struct(F.lit(level).alias("Level"), F.trunc("Start", level).alias("Start")) for level in ("month", "year")]
    above = (days.where("Level = 'day'").select(F.explode(F.array(*up)).alias("n"), "FirstDay", "LastDay", *_SUMS)
             .groupBy("n.Level", "n.Start").agg(F.min("FirstDay").alias("FirstDay"), F.max("LastDay").alias("LastDay"), *sums)
             .withColumn("Parent", F.when(F.col("Level") == "month", F.trunc("Start", "year"))))
    return days.select(*COLUMNS).unionAll(above.select(*COLUMNS))


def sum_tree(sales: DataFrame) -> DataFrame:
    """The nodes of ``sales``, read once; store them (a few hundred rows for each year)."""
    return _grown(_day_sums(sales))


def fold_sums(tree: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The stored ``tree`` after sales were added and removed (an edit is both); only the tree and the batch are read."""
    stored = tree.where("Level in ('day', 'cut')")
    parts = [_day_sums(rows, sign) for rows, sign in ((added, 1), (removed, -1)) if rows is not None]
    names = ["Level", "Start", *[c for c in _SUMS if c != "Days"]]
    return _grown(reduce(DataFrame.unionAll, [p.select(*names) for p in [stored, *parts]]))


def _next_month(d: _dt.date) -> _dt.date:
    return _dt.date(d.year + d.month // 12, d.month % 12 + 1, 1)


def whole_months(start: _dt.date, end: _dt.date) -> tuple[_dt.date, _dt.date]:
    """The first whole month of a range and the first that is not, the month of its last day; none are whole if they don't ascend."""
    return (start if start.day == 1 else _next_month(start.replace(day=1))), end.replace(day=1)


def cover(start: _dt.date, end: _dt.date) -> Column:
    """Which nodes make up ``start 00:00:00 .. end 23:59:59``, as a filter of at most six date ranges; an empty range has none."""
    def span(level: str, a: _dt.date, b: _dt.date) -> Column:
        return (F.col("Level") == level) & (F.col("Start") >= date_lit(a)) & (F.col("Start") < date_lit(b))

    if start > end:
        return F.lit(False)
    # whole months lie in [months, months_end), whole years in [years, years_end); both may be empty
    months, months_end = whole_months(start, end)
    picked = [(F.col("Level") == "cut") & (F.col("Start") == date_lit(end))]
    if months >= months_end:
        return picked[0] | span("day", start, end)
    picked += [span("day", start, months), span("day", months_end, end)]
    years = months if months.month == 1 else _dt.date(months.year + 1, 1, 1)
    years_end = _dt.date(months_end.year, 1, 1)
    if years >= years_end:
        picked.append(span("month", months, months_end))
    else:
        picked += [span("month", months, years), span("year", years, years_end), span("month", years_end, months_end)]
    return reduce(lambda a, b: a | b, picked)


def totals_of(tree: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """``reports.report_totals`` from the stored sums."""
    days = max((end - start).days + 1, 1)
    total = tree.where(cover(start, end)).agg(F.coalesce(F.sum("Amount"), F.lit(0)).cast(MONEY).alias("TotalRevenue"),
                                              F.coalesce(F.sum("Items"), F.lit(0)).cast("long").alias("TotalItems"))
    return total.withColumn("Days", F.lit(days)).withColumn(
        "DailyAverage", F.round(F.col("TotalRevenue").cast("double") / F.lit(float(days)), 4))


def _revenue() -> Column:
    """A node's amount; none if none of its sales has one."""
    return F.when(F.col("Priced") > 0, F.col("Amount"))


def daily_of(tree: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """``reports.daily_sales`` from the stored sums."""
    whole = (F.col("Level") == "day") & (F.col("Start") >= date_lit(start)) & (F.col("Start") < date_lit(end))
    last = (F.col("Level") == "cut") & (F.col("Start") == date_lit(end)) & F.lit(start <= end)
    return tree.where(whole | last).select(F.col("Start").alias("SaleDay"), _revenue().alias("DailyTotal")).orderBy("SaleDay")


def trend_of(tree: DataFrame, start: _dt.date, end: _dt.date, max_points: int = P.MAX_TREND_POINTS) -> DataFrame:
    """``reports.sales_trend_binned`` from the stored sums.

    Nodes carry their number of selling days, so the running count over the range's nodes tells which points a node
    touches.  A node inside one point counts whole; one across an end of points is opened into the nodes below it, years
    first, then months: at most one for each point's end.  The window orders the nodes of a range (dozens, and one for each year).
    """
    nodes = tree.where(cover(start, end)).select(*COLUMNS)
    size = F.ceil(nodes.agg(F.sum("Days")).scalar() / F.lit(max_points))
    child = F.create_map(*[F.lit(x) for pair in _CHILD.items() for x in pair])

    def placed(nodes: DataFrame) -> DataFrame:
        upto = F.sum("Days").over(Window.orderBy("Start"))
        return nodes.withColumn("Point", F.floor((upto - F.col("Days")) / size)).withColumn("LastPoint", F.floor((upto - 1) / size))

    for _ in _CHILD:
        at = placed(nodes)
        split = at.where("Point <> LastPoint").select(child[F.col("Level")].alias("Level"), F.col("Start").alias("Parent"))
        nodes = at.where("Point = LastPoint").select(*COLUMNS).unionAll(
            tree.join(split, ["Level", "Parent"], "left_semi").select(*COLUMNS))
    pts = placed(nodes).groupBy(F.col("Point").cast("int").alias("Point")).agg(
        F.min("FirstDay").alias("FirstDay"), F.max("LastDay").alias("LastDay"), F.sum(_revenue()).alias("Value"))
    label = F.when(F.col("FirstDay") == F.col("LastDay"), day_label("FirstDay")) \
        .otherwise(F.concat(day_label("FirstDay"), F.lit(" - "), day_label("LastDay")))
    return pts.select("Point", "FirstDay", "LastDay", label.alias("Label"), "Value").orderBy("Point")
