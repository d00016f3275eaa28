"""ORDER BY, limits, ROWNUM and windows with the dialect's order of nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lattica.functions.compat import asc, desc
from lattica.sources.scratch import materialised


def keys(*by: str | Column) -> list[Column]:
    """Sort keys from names: a leading minus means descending. Nulls come last ascending and first descending."""
    return [b if isinstance(b, Column) else desc(b[1:]) if b.startswith("-") else asc(b) for b in by]


def order_by(df: DataFrame, *by: str | Column) -> DataFrame:
    return df.orderBy(*keys(*by))


def limit(df: DataFrame, count: int | None = None, offset: int = 0, by: Sequence[str | Column] = ()) -> DataFrame:
    """LIMIT and OFFSET after a sort, if any: a top-N where Spark needs no full sort."""
    for n in (count, offset):
        if n is not None and (not isinstance(n, int) or n < 0):
            raise ValueError("LIMIT and OFFSET take whole numbers from zero")
    out = df.orderBy(*keys(*by)) if by else df
    out = out.offset(offset) if offset else out
    return out if count is None else out.limit(count)


def rownum_at_most(df: DataFrame, n: int) -> DataFrame:
    """WHERE ROWNUM <= n: the first n rows before any sort. ROWNUM > n for n of one or more is never true: use df.limit(0)."""
    return df.limit(max(0, n))


def with_found_rows(df: DataFrame, page: DataFrame, name: str = "found_rows") -> DataFrame:
    """page, rows of df behind a limit, with how many df has: FOUND_ROWS. The count is one row, which is broadcast."""
    return page.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))


def with_rownum(df: DataFrame, *by: str | Column, name: str = "rownum") -> DataFrame:
    """A gap-free row number over the whole result in the order of the keys, or without keys in the order in which its
    partitions have the rows, without one task holding all rows.

    Rows are range-partitioned, numbered within their partitions and written once, so that partitions are the
    same ones for the second step, which adds the number of rows in earlier partitions: one small row for each.
    Rows that tie are dealt by a hash of their columns, so that a key that many rows share is no single partition.
    """
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    order = [*keys(*by), F.xxhash64(*hashed)] if by else []
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if by else df
    dealt = dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    held = materialised(dealt, "rownum")
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def over(partition: Sequence[str], *by: str | Column) -> WindowSpec:
    spec = W.partitionBy(*partition)
    return spec.orderBy(*keys(*by)) if by else spec


def count_distinct_over(x: Column, spec: WindowSpec) -> Column:
    """COUNT(DISTINCT x) OVER (PARTITION BY ...), which Spark doesn't take as such."""
    return F.size(F.collect_set(x).over(spec))


def spread_over(x: Column, spec: WindowSpec, aggregate=F.stddev_samp) -> Column:
    """STDDEV and VARIANCE as window functions: zero for a single value."""
    return F.when(F.count(x).over(spec) == 1, F.lit(0.0)).otherwise(aggregate(x).over(spec))


def listagg_over(x: Column, partition: Sequence[str], separator: str = "") -> Column:
    return F.array_join(F.array_sort(F.collect_list(x.cast("string")).over(W.partitionBy(*partition))), separator)


def moving_sum(df: DataFrame, partition: Sequence[str], by: str, start: Column, end: Column, x: str, name: str) -> DataFrame:
    """SUM over a ROWS frame whose bounds are expressions of the row: see frames.moving()."""
    from lattica.operators.frames import moving

    return moving(df, partition, by, start, end, {name: ("sum", x)})
