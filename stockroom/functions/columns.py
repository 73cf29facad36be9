"""Column expressions (all built-in Spark functions, no Python UDFs).

These reproduce the small scalar behaviours of the application: PHP-style
emptiness and trimming, case-insensitive substring search, status labels,
money parsing, date ranges and labels.
"""

from __future__ import annotations

import datetime as _dt
import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P

# ---- fixed values -----------------------------------------------------------
# Characters PHP trim() strips: space, tab, newline, carriage return, NUL, VT.
PHP_TRIM_CLASS = "[ \\t\\n\\r\\x00\\x0B]"
# Leading numeric prefix that PHP floatval() reads.
PHP_FLOAT_PREFIX = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- text -------------------------------------------------------------------
def php_trim(c: Column | str) -> Column:
    """PHP trim(): strip space, \\t, \\n, \\r, NUL and VT at both ends."""
    return F.regexp_replace(col_(c), f"^{PHP_TRIM_CLASS}+|{PHP_TRIM_CLASS}+$", "")


def php_empty(c: Column | str) -> Column:
    """PHP empty() on a string: NULL, "" and "0" are empty."""
    c = col_(c)
    return c.isNull() | c.isin("", "0")


def display_default(c: Column | str, default: str) -> Column:
    """PHP ``$x ?: default`` for display text."""
    c = col_(c)
    return F.when(php_empty(c), F.lit(default)).otherwise(c.cast("string"))


def contains_ci(c: Column | str, term: str) -> Column:
    """Case-insensitive literal substring test (``%`` and ``_`` are literal)."""
    return F.lower(col_(c).cast("string")).contains(F.lit(term.lower()))


def any_contains_ci(cols, term: str) -> Column:
    """True when any of ``cols`` contains ``term``, ignoring case."""
    return reduce(lambda a, b: a | b, [F.coalesce(contains_ci(c, term), F.lit(False)) for c in cols])


def clean_role(c: Column | str) -> Column:
    """Role name cleaning: trim, lower-case, drop all whitespace."""
    return F.regexp_replace(F.lower(php_trim(F.coalesce(col_(c), F.lit("")))), "\\s+", "")


def role_bucket(c: Column | str) -> Column:
    cleaned = clean_role(c)
    return (F.when(cleaned == "admin", F.lit("admin"))
            .when(cleaned == "customer", F.lit("customer"))
            .otherwise(F.lit("staff")))


# ---- status labels ----------------------------------------------------------
def stock_status(c: Column | str, low: int = P.LOW_STOCK_THRESHOLD) -> Column:
    c = col_(c)
    return (F.when(c <= 0, F.lit(P.STATUS_OUT))
            .when(c < low, F.lit(P.STATUS_LOW))
            .otherwise(F.lit(P.STATUS_IN)))


def sale_form_status(c: Column | str, low: int = P.SALE_FORM_LOW_THRESHOLD) -> Column:
    c = col_(c)
    return F.when(c < low, F.lit(P.STATUS_LOW)).otherwise(F.lit(P.STATUS_IN))


# ---- numbers and money --------------------------------------------------------
def php_floatval(c: Column | str) -> Column:
    """PHP floatval(): the leading numeric prefix after whitespace, else 0."""
    prefix = F.regexp_extract(F.regexp_replace(col_(c), f"^{PHP_TRIM_CLASS}+", ""), PHP_FLOAT_PREFIX, 0)
    return F.coalesce(F.nullif(prefix, F.lit("")).try_cast("double"), F.lit(0.0))


def is_numeric_text(c: Column | str) -> Column:
    """Text that parses as a number (PHP is_numeric, decimal forms)."""
    c = php_trim(col_(c))
    return c.rlike("^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$")


def discount_pct(c: Column | str) -> Column:
    """Discount percent: numeric text, else 0 (no 0..100 check, as on the server); NULL if it is 1e8 or more."""
    c = col_(c)
    return F.when(is_numeric_text(c), php_trim(c).try_cast("decimal(16,8)")) \
        .otherwise(F.lit(0).cast("decimal(16,8)"))


def whole_number(c: Column | str) -> Column:
    """A whole number given as text in any numeric form ("5", "5.0", "1e1"); NULL if it is none or needs over 64 bits."""
    value = php_trim(col_(c)).try_cast("decimal(38,10)")
    return F.when(is_numeric_text(c) & (value == F.floor(value)), value.try_cast("bigint"))


def subtotal(price: Column | str, quantity: Column | str) -> Column:
    """Price x quantity in cents; NULL if it doesn't fit decimal(18,2)."""
    return (col_(price) * col_(quantity)).try_cast("decimal(18,2)")


def discounted(amount: Column, percent: Column, kind: str) -> Column:
    """``amount`` less ``percent`` percent, rounded to cents; NULL if it doesn't fit ``kind``."""
    return F.round(amount - amount * percent * F.lit(Decimal("0.01")), 2).try_cast(kind)


def option_name(c: Column | str) -> Column:
    """The name in an option label "name - price": what stands before the first dash, trimmed."""
    return F.trim(F.element_at(F.split(col_(c), "-"), 1))


# ---- dates ------------------------------------------------------------------
def as_date(d: _dt.date | str | None) -> _dt.date | None:
    """A date given as such or as form text ("2000-06-01"); text that is empty or no date is none."""
    if not isinstance(d, str):
        return d or None
    try:
        return _dt.date.fromisoformat(d.strip())
    except ValueError:
        return None


def as_key(text: int | str | None) -> int | None:
    """An id given as such or as form text: its leading whole number, as a database compares text with a number; text
    without one is 0, which is no row's id.  Nothing, empty text and "0" are none."""
    if text in (None, "", "0", 0):
        return None
    lead = re.match(r"\s*[+-]?\d+", str(text))
    return int(lead.group()) if lead else 0


def ts_lit(d: _dt.date | _dt.datetime, time: str = "00:00:00") -> Column:
    """A TIMESTAMP_NTZ literal (the tables store wall-clock timestamps)."""
    if isinstance(d, _dt.datetime):
        text = d.strftime("%Y-%m-%d %H:%M:%S")
    else:
        text = f"{d.isoformat()} {time}"
    return F.lit(text).cast("timestamp_ntz")


def date_lit(d: _dt.date) -> Column:
    return F.lit(d.isoformat()).cast("date")


def on_day(c: Column | str, d: _dt.date) -> Column:
    """Same calendar day as ``d`` (half-open range, so the scan filter is pushed)."""
    c = col_(c)
    return (c >= ts_lit(d)) & (c < ts_lit(d + _dt.timedelta(days=1)))


def in_month_of(c: Column | str, d: _dt.date) -> Column:
    """Same month and year as ``d`` as a half-open range (pushable)."""
    c = col_(c)
    first = d.replace(day=1)
    nxt = (first.replace(year=first.year + 1, month=1) if first.month == 12
           else first.replace(month=first.month + 1))
    return (c >= ts_lit(first)) & (c < ts_lit(nxt))


def since_days_before(c: Column | str, d: _dt.date, days: int) -> Column:
    """``c >= d - days`` (inclusive lower bound, no upper bound)."""
    return col_(c) >= ts_lit(d - _dt.timedelta(days=days))


def closed_range(c: Column | str, start: _dt.date, end: _dt.date) -> Column:
    """``BETWEEN start 00:00:00 AND end 23:59:59`` (fractions after :59 fall out)."""
    return col_(c).between(ts_lit(start), ts_lit(end, "23:59:59"))


def before_day_after(c: Column | str, d: _dt.date) -> Column:
    """Rows up to the end of day ``d``: the as-of slice."""
    return col_(c) < ts_lit(d + _dt.timedelta(days=1))


def day_label(c: Column | str) -> Column:
    return F.date_format(col_(c), P.LABEL_DAY)


def report_range(as_of: _dt.date, start: _dt.date | str | None = None,
                 end: _dt.date | str | None = None) -> tuple[_dt.date, _dt.date]:
    """The asked range; by default from the first day of the as-of month, and up to as_of."""
    return as_date(start) or as_of.replace(day=1), as_date(end) or as_of


def money_text(c: Column | str) -> Column:
    """"$1,234.50": currency sign, thousands separators, two decimals."""
    return F.concat(F.lit("$"), F.format_number(col_(c), 2))


def count_text(c: Column | str) -> Column:
    """"12,345": thousands separators, no decimals."""
    return F.format_number(col_(c), 0)


def percent_text(c: Column | str) -> Column:
    """"12.3%": one decimal and a percent sign (NULL stays NULL)."""
    return F.concat(F.format_number(col_(c), 1), F.lit("%"))


# ---- partition pruning on the stored layout ---------------------------------
MONTH_PARTITION = "SaleMonth"  # written by sources.write_tables as 'yyyy-MM'


def with_month_pruning(df, start: _dt.date | None, end: _dt.date | None):
    """Add a ``SaleMonth`` range matching a SaleDate range, when the frame has that partition column.

    Spark cannot derive a partition filter from a predicate on ``SaleDate``;
    this extra, implied predicate lets it skip whole month directories.
    """
    if MONTH_PARTITION not in df.columns:
        return df
    if start is not None:
        df = df.where(F.col(MONTH_PARTITION) >= F.lit(start.strftime("%Y-%m")))
    if end is not None:
        df = df.where(F.col(MONTH_PARTITION) <= F.lit(end.strftime("%Y-%m")))
    return df
