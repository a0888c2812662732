"""Registry of named queries and their DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables (through
the fixture views). ``sql`` is the equivalent ANSI SQL over the same tables,
or ``None`` for randomised / model / IO operators that get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.stats import round_half_away
from ..sources.fixtures import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn
    return deco


def r6(c) -> Column:
    """Round to 6 places; + 0.0 folds -0.0 into 0.0."""
    return round_half_away(c, 6) + F.lit(0.0)


def s6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"
