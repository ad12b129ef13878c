"""Collects queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [
    "survey_queries",
    "index_queries",
    "statement_queries",
    "label_queries",
    "crosswalk_queries",
    "agreement_queries",
    "sampling_queries",
    "release_queries",
    "panel_queries",
    "regression_queries",
    "typology_queries",
    "contract_queries",
    "source_queries",
]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists the inventory rows it exercises."""

    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(run, sql, tuple(covers.split()))
        return run

    return add


def load() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"weftspan.catalog.{module}")
    return ENTRIES


def all_queries() -> dict[str, Query]:
    return {name: e.run for name, e in load().items()}


def all_sql() -> dict[str, str]:
    return {name: e.sql for name, e in load().items() if e.sql}


def r(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded double for comparison between engines."""
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column.cast("double"), digits).alias(name or c)
