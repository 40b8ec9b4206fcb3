"""The two registries and the decorator that fills them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(column, name: str):
    """Rounded to six places, so that summation order does not show."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name)
