"""Query registry: name -> (builder over RetailTables, DuckDB oracle SQL or None)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame

from .oracle import with_adapter


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable  # (RetailTables) -> DataFrame
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle_body: str | None = None, extra_ctes: str = "", recursive: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle body."""

    def deco(fn: Callable[..., DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        sql = with_adapter(oracle_body, extra_ctes, recursive) if oracle_body else None
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn

    return deco
