"""Query catalog: every registered query with its DuckDB oracle text."""

from __future__ import annotations

# Importing a module registers its queries, in this order.
from . import q_stock, q_sales, q_parties, q_cart, q_changes, q_sequential, q_sinks, q_stream, q_store, q_ranges  # noqa: F401, I001
from .registry import REGISTRY, Query, query  # noqa: F401
