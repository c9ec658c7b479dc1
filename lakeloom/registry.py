"""All queries of the relational part, by name, with their SQL twins.

A query is registered where it is defined, together with its twin, so the two can't drift apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame; sql is what DuckDB runs on the same tables."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    """Imports all modules that register queries."""
    from lakeloom.functions import arrays, dates, nested, numbers, strings, udfs, user_aggregates  # noqa: F401
    from lakeloom.operators import aggregates, assembly, copies, heavy, joins, pareto, reports, sets, sketches, subqueries, windows  # noqa: F401
    from lakeloom.plans import intervals, neighbours, overlaps, vectors  # noqa: F401
    from lakeloom.sources import formats, scans  # noqa: F401
    from lakeloom.streaming import batch_windows, stream_joins, streams, timers, upserts  # noqa: F401
