"""Fixed values.

Thresholds, page sizes and report limits below are the application's own
constants and must keep these values for results to match.  The dates are the
fixed ``as_of`` / report parameters used with the supplied test tables (the
library never reads the wall clock).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

# ---- fixed values (application constants) ---------------------------------
LOW_STOCK_THRESHOLD = 10        # stock status: <= 0 out, < 10 low, else in stock
SALE_FORM_LOW_THRESHOLD = 5     # sale-form status: < 5 low, else in stock
LOW_LOT_THRESHOLD = 10          # a receipt lot with fewer units is a "low lot"
PAGE_SIZE = 10                  # sales history page
TOP_PRODUCTS = 5
TOP_SUPPLIERS = 5
RECENT_RECEIPTS = 10
FEED_BRANCH = 3                 # recent activity: 3 newest of each kind ...
FEED_SIZE = 5                   # ... merged, 5 newest overall
TRAILING_DAYS = 7               # "last 7 days" window, lower bound inclusive
DENSE_SERIES_DAYS = 7           # dashboard chart points
MAX_TREND_POINTS = 10           # report chart points
DEFAULT_ADD_QUANTITY = 1        # cart add without quantity

STATUS_OUT = "Out of Stock"
STATUS_LOW = "Low Stock"
STATUS_IN = "In Stock"

NO_DESCRIPTION = "No description available."
NO_EMAIL = "No email"
DASH = "-"

# Date label formats (Spark datetime patterns for the PHP formats
# 'M d', 'M d, Y', 'M d, Y H:i', 'm/d/Y H:i').
LABEL_DAY = "MMM dd"
LABEL_DATE = "MMM dd, yyyy"
LABEL_DATETIME = "MMM dd, yyyy HH:mm"
LABEL_FEED = "MM/dd/yyyy HH:mm"


@dataclass(frozen=True)
class RunParams:
    """Parameters that replace the request and the clock."""

    as_of: _dt.date = _dt.date(2000, 6, 15)
    # the default report range for as_of: first of its month .. as_of
    report_start: _dt.date = _dt.date(2000, 6, 1)
    report_end: _dt.date = _dt.date(2000, 6, 15)
    long_start: _dt.date = _dt.date(1995, 1, 1)
    long_end: _dt.date = _dt.date(2001, 12, 31)
    recent_stock_from: _dt.date = _dt.date(2001, 1, 1)
    history_page: int = 2
    product_id: int = 7
    search_term: str = "sMa"
    stock_search_term: str = "low"
    receipt_search_term: str = "bolt"
    supplier_search_term: str = "ring"
    category: str = "small"
    reserve_quantity: int = 5


DEFAULT = RunParams()
