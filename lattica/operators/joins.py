"""Joins beyond DataFrame.join: outer-join markers, null-aware anti, quantified comparison, ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plus_join(left: DataFrame, right: DataFrame, on: Column, optional: str = "right") -> DataFrame:
    """The (+) marker: rows of the other side are kept where the optional side has no match."""
    return left.join(right, on, {"right": "left", "left": "right"}[optional])


def not_in(left: DataFrame, right: DataFrame, keys: Sequence[str], other: Sequence[str] | None = None) -> DataFrame:
    """NOT IN (subquery): a null on either side makes the comparison unknown, so that row doesn't qualify.

    A single key is an equi-join, and the nulls are decided by one row of counts. Of several keys, two rows are
    compared in those that neither has null: each set of such keys is one equi-join, and for the empty set the
    patterns of nulls, a row for each, are broadcast.
    """
    other = list(other or keys)
    if len(keys) != 1:
        return _not_in_several(left, right, list(keys), other)
    stats = right.agg(F.count(F.lit(1)).alias("_rows"), F.count(F.when(right[other[0]].isNull(), 1)).alias("_nulls"))
    kept = left.join(right.select(F.col(other[0]).alias("_o")).filter("_o is not null").distinct(), left[keys[0]] == F.col("_o"), "left_anti")
    return kept.join(F.broadcast(stats)).filter((F.col("_rows") == 0) | ((F.col("_nulls") == 0) & F.col(keys[0]).isNotNull())).drop("_rows", "_nulls")  # stats is one row


def _not_in_several(left: DataFrame, right: DataFrame, keys: list[str], other: list[str]) -> DataFrame:
    def known(columns: list[str], nullable: list[bool]):
        """A number whose bits say which of the columns aren't null."""
        return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) if null else F.lit(1 << i) for i, (c, null) in enumerate(zip(columns, nullable, strict=True))))

    nullable = [left.schema[k].nullable or right.schema[o].nullable for k, o in zip(keys, other, strict=True)]
    held = left.select(F.struct(*left.columns).alias("_row"), *(F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)), known(keys, nullable).alias("_lk"))
    found = right.select(*(F.col(o).alias(f"_r{i}") for i, o in enumerate(other)), known(other, nullable).alias("_rk")).distinct()
    always = sum(1 << i for i, null in enumerate(nullable) if not null)
    for both in range(1 << len(keys)):
        if both & always != always:
            continue
        same = F.col("_lk").bitwiseAND(F.col("_rk")) == both
        if not both:
            held = held.join(F.broadcast(found.select("_rk").distinct()), same, "left_anti")  # at most 2 ** len(keys) rows
        else:
            held = held.join(found, reduce(lambda a, b: a & b, (F.col(f"_l{i}") == F.col(f"_r{i}") for i in range(len(keys)) if both >> i & 1)) & same, "left_anti")
    return held.select("_row.*")


def any_all(df: DataFrame, x: Column, op: str, quantifier: str, values: DataFrame, column: str) -> DataFrame:
    """Rows of df for which `x op ANY|ALL (values.column)` is true, from the extremes of the values: one row is broadcast.

    ANY of no values is false and ALL of none is true; nulls among them make a comparison unknown unless it
    is decided without them.
    """
    every = quantifier.upper() == "ALL"
    named = df.withColumn("_x", x)
    if op == "=" and not every:
        return named.join(values.select(F.col(column).alias("_o")).distinct(), F.col("_x") == F.col("_o"), "left_semi").drop("_x")
    if op == "<>" and every:
        return not_in(named, values, ["_x"], [column]).drop("_x")
    c = F.col(column)
    seen = values.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), F.count(F.lit(1)).alias("_n"), F.count(F.when(c.isNull(), 1)).alias("_nulls"))
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    low, high = (hi, lo) if every else (lo, hi)  # what x has to be above, or below
    test = {"=": (x == lo) & (x == hi), "<>": (x != lo) | (x != hi), ">": x > low, ">=": x >= low, "<": x < high, "<=": x <= high}[op]
    decided = F.coalesce(test, F.lit(False))
    keep = (F.col("_n") == 0) | (decided & (F.col("_nulls") == 0)) if every else decided
    return named.join(F.broadcast(seen)).filter(keep).drop("_x", "_lo", "_hi", "_n", "_nulls")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Inner join on low <= at < high, as an equi-join on buckets: each range is listed under the two or three buckets that it
    spans of the least of the widths width, 2 * width, 4 * width, ... that isn't below its length, and each point under its
    bucket of every width that some range has.

    Choose width near the usual length of a range; every pair comes out once. The widths in use, a few dozen at most, are
    found first.
    """
    length = F.col(high) - F.col(low)
    level = F.greatest(F.lit(0), F.ceil(F.log2(length / width))).cast("int")
    wide = ranges.filter(length > 0).withColumn("_level", level)
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("_level"))
    listed = wide.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    levels = sorted(r[0] for r in wide.select("_level").distinct().collect())
    if not levels:
        levels = [0]
    probes = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_bucket", F.floor(F.col(at) / size))
    return probes.join(listed, ["_level", "_bucket"]).filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bucket", "_level")


def lookup_aggregate(outer: DataFrame, inner: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """A correlated scalar aggregate: inner is grouped once by the correlation keys and looked up; counts of no rows need a coalesce."""
    return outer.join(inner.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items())), list(keys), "left")
