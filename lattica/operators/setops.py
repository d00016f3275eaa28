"""Set operations: all of one precedence, from left to right, over columns cast to common types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATIONS = {
    "union all": lambda a, b: a.unionAll(b),
    "union": lambda a, b: a.unionAll(b).distinct(),
    "intersect": lambda a, b: a.intersect(b),
    "intersect all": lambda a, b: a.intersectAll(b),
    "minus": lambda a, b: a.subtract(b),
    "except": lambda a, b: a.subtract(b),
    "except all": lambda a, b: a.exceptAll(b),
}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """What columns of two types become in a set operation: equal types stay, numbers widen, dates become timestamps, text takes text only."""
    if a == b:
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, (T.DoubleType, T.FloatType)) or isinstance(b, (T.DoubleType, T.FloatType)):
            return T.DoubleType()
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            digits = [(t.precision, t.scale) if isinstance(t, T.DecimalType) else (20, 0) for t in (a, b)]
            scale = max(s for _, s in digits)
            return T.DecimalType(min(38, max(p - s for p, s in digits) + scale), scale)
        return T.LongType()
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, dates) and isinstance(b, dates):
        return T.TimestampType() if T.TimestampType() in (a, b) else T.TimestampNTZType()
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    raise TypeError(f"{a.simpleString()} and {b.simpleString()} don't go together")


def combine(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """first OP second OP third ... with the first's names; a different number of columns is an error."""
    out = first
    for operation, other in rest:
        if len(out.columns) != len(other.columns):
            raise ValueError("both sides need the same number of columns")
        kinds = [common_type(a.dataType, b.dataType) for a, b in zip(out.schema, other.schema, strict=True)]
        sides = [side.select(*(F.col(c).cast(k).alias(n) for c, k, n in zip(side.columns, kinds, out.columns, strict=True))) for side in (out, other)]
        out = OPERATIONS[operation.lower()](*sides)
    return out
