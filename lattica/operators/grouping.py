"""Grouping sets, pivot and unpivot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column, having: Column | None = None) -> DataFrame:
    """GROUP BY GROUPING SETS; columns that a set leaves out are null. Spark expands the rows and aggregates once."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*aggregates)
    return out if having is None else out.filter(having)


def combined_sets(*items: Sequence[Sequence[str]]) -> list[list[str]]:
    """The grouping sets of several GROUP BY items side by side: every combination of one set of each."""
    out: list[list[str]] = [[]]
    for sets in items:
        out = [a + [c for c in s if c not in a] for a in out for s in sets]
    return out


def rollup_sets(columns: Sequence[str]) -> list[list[str]]:
    return [list(columns[:n]) for n in range(len(columns), -1, -1)]


def cube_sets(columns: Sequence[str]) -> list[list[str]]:
    return [[c for i, c in enumerate(columns) if not mask >> (len(columns) - 1 - i) & 1] for mask in range(2 ** len(columns))]


def pivot(df: DataFrame, keys: Sequence[str], over: str, values: Mapping[object, str], **aggregates: Column) -> DataFrame:
    """PIVOT (aggregates FOR over IN (value AS name, ...)): a column name_aggregate for each; plain name for a single aggregate."""
    wide = df.groupBy(*keys).pivot(over, list(values)).agg(*(c.alias(a) for a, c in aggregates.items()))
    names = {f"{v}_{a}" if len(aggregates) > 1 else str(v): f"{n}_{a}" if len(aggregates) > 1 else n for v, n in values.items() for a in aggregates}
    return wide.withColumnsRenamed(names)


def unpivot(df: DataFrame, keys: Sequence[str], columns: Mapping[str, object], name: str, value: str, include_nulls: bool = False) -> DataFrame:
    """UNPIVOT: a row for each of the columns, tagged with its label; null values are left out by default."""
    pairs = F.explode(F.array(*(F.struct(F.lit(label).alias(name), F.col(c).alias(value)) for c, label in columns.items())))
    out = df.select(*keys, pairs.alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")
    return out if include_nulls else out.filter(F.col(value).isNotNull())
