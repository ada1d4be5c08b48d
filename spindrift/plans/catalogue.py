"""The registry of named queries: a function of (spark, sf_dir) and, where there is one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.schema import VISITS_SQL, load, visits

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_VISITS = f"visits AS ({VISITS_SQL.format(events='events')})"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name; ``{V}`` in ``sql`` stands for the visit view."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{V}", _VISITS)
        return f

    return add


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


__all__ = ["ORACLES", "QUERIES", "big", "load", "query", "visits"]
