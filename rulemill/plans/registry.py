"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import virtual

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, inputs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql reads the virtual inputs by their names."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_inputs(sql, inputs)
        return f

    return add


def with_inputs(sql: str, inputs: tuple[str, ...]) -> str:
    """sql after common table expressions of its inputs; sql may start with more of them (`, name AS (...) SELECT`)."""
    ctes = ",\n".join(f"{n} AS ({virtual.duck(n)})" for n in inputs)
    body = sql.strip()
    if not ctes:
        return body
    recursive = "RECURSIVE " if "/*recursive*/" in body else ""
    return f"WITH {recursive}{ctes}\n{body}"
