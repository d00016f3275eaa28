"""Functions of the user's own: scalar, vectorised, aggregate and table functions, known to SQL and the DataFrame API."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def scalar(spark: SparkSession, name: str, f: Callable, returns: str) -> Callable:
    """A function of single values, sent over in Arrow batches."""
    return spark.udf.register(name, F.udf(f, returns, useArrow=True))


def vectorised(spark: SparkSession, name: str, f: Callable, returns: str) -> Callable:
    """A function of pandas Series with type hints; from Series to a single value it is an aggregate."""
    return spark.udf.register(name, F.pandas_udf(f, returns))


def table(spark: SparkSession, name: str, cls: type, returns: str) -> Callable:
    """A class whose eval() yields rows; call it in FROM, with LATERAL for columns of tables before it."""
    made = F.udtf(cls, returnType=returns)
    spark.udtf.register(name, made)
    return made


def expression(spark: SparkSession, head: str, returns: str, body: str) -> None:
    """A function in SQL, which Catalyst inlines: prefer it where SQL can say it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")
