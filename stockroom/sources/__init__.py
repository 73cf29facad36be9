"""Sources (table loaders) and sinks (CSV / JSON writers)."""

from .retail import TABLES, RetailTables, write_bucketed, write_tables  # noqa: F401
from .store import TableStore  # noqa: F401
