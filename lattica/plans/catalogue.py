"""All registered queries and their SQL oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **kinds: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows, if SQL can say it.

    kinds: types that the SQL engine gives otherwise than Spark, by column.
    """
    if sql and kinds:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {k}) AS {c}' for c, k in kinds.items())}) FROM ({sql})"

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _fill() -> None:
    from lattica.plans import changing, dialect, functional, library, relational  # noqa: F401


_fill()
