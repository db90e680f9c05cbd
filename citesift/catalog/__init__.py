"""Registry of the named queries the driver runs (``queries()``) and their DuckDB oracles (``oracle_sql()``).

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the driver tables in ``sf_dir``; the
oracle is an independent SQL statement over the same tables.  Column names and types agree between the
two.  Queries with no oracle are checked on row counts only (streams and approximate joins).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle statement."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def _load_all() -> None:
    # import order fixes registry order
    from citesift.catalog import (  # noqa: F401
        retrieval,
        loop,
        corpus,
        attempts,
        prompts,
        quality,
        streams,
        texts,
        golden,
        reindex,
        lists,
        run_report,
        ledger,
    )


_load_all()
