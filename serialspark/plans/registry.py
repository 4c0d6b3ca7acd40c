"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from serialspark.plans.fixtures import duck

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) and the SQL that gives the same rows; names in braces are fixtures."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = duck(sql)
        return f

    return add
