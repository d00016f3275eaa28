"""Window aggregates over frames whose bounds are expressions of the row.

Where no frame of a table reaches over more than SHORT rows, each row gets the values of its neighbours by LAG and LEAD
and cuts its own frame out of them: one sort, no join. Otherwise a frame is cut into blocks of 1, 2, 4, ... rows, of
which it has at most two of each size. The aggregates of all blocks up to the longest frame's size are made once and
joined to the frames, so work grows with the logarithm of the frames. Both sides of these joins grow with the rows, which
the size of a well-compressed scratch file doesn't show: they are merge joins by a hint, so that no side goes through
the driver as a broadcast. Either way sums are made by adding only: no difference of running totals loses digits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import WindowSpec

from lattica.operators.ordering import keys, over
from lattica.sources.scratch import materialised

BLOCKS = "array<struct<k:int,b:bigint>>"
SHORT = 32


def _blocks(low: Column, high: Column, levels: int) -> Column:
    """The blocks (k, b), rows b * 2**k up to (b + 1) * 2**k, that make up the rows from low up to high."""

    def step(acc: Column, k: Column) -> Column:
        live = acc["l"] < acc["r"]
        left, right = live & (acc["l"] % 2 == 1), live & (acc["r"] % 2 == 1)
        l2, r2 = acc["l"] + left.cast("bigint"), acc["r"] - right.cast("bigint")

        def one(taken: Column, b: Column) -> Column:
            return F.when(taken, F.array(F.struct(k.alias("k"), b.alias("b")))).otherwise(F.array().cast(BLOCKS))

        return F.struct(F.floor(l2 / 2).cast("bigint").alias("l"), F.floor(r2 / 2).cast("bigint").alias("r"), F.concat(acc["out"], one(left, acc["l"]), one(right, r2)).alias("out"))

    start = F.struct(low.cast("bigint").alias("l"), high.cast("bigint").alias("r"), F.array().cast(BLOCKS).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc["out"])


def _range_bounds(base: DataFrame, levels: int = 0) -> DataFrame:
    """(_g, _rn, _lo, _hi): how many rows of the partition lie below the frame, and how many up to its end."""
    probes = F.array(*(F.struct(v.cast("double").alias("v"), F.lit(kind).alias("kind")) for kind, v in enumerate((F.col("_by") - F.col("_start"), F.col("_by"), F.col("_by") + F.col("_end")))))
    listed = base.filter("_by is not null").select("_g", "_rn", F.explode(probes).alias("probe")).select("_g", "_rn", "probe.v", "probe.kind")
    running = F.sum((F.col("kind") == 1).cast("bigint")).over(W.partitionBy("_g").orderBy("v", "kind"))  # peers included
    counted = listed.withColumn("upto", running)
    return counted.groupBy("_g", "_rn").agg(F.max(F.when(F.col("kind") == 0, F.col("upto"))).alias("_lo"), F.max(F.when(F.col("kind") == 2, F.col("upto"))).alias("_hi"))


def _reach(df: DataFrame, start: Column, end: Column) -> tuple[int, int] | None:
    """The furthest rows before and after a row that any frame of the table takes in; None if all frames are empty."""
    before, after = df.filter(start + end >= 0).agg(F.max(start), F.max(end)).first()
    return None if before is None else (before, after)


def _near(df: DataFrame, spec: WindowSpec, start: Column, end: Column, reach: tuple[int, int], aggregates: Mapping[str, tuple[str, str]]) -> DataFrame:
    """moving() over rows, for frames within reach. Beyond the ends of a partition LAG and LEAD give null, which the aggregates skip."""
    before, after = reach
    columns = sorted({c for _, c in aggregates.values()})
    around = {f"_near{i}": F.array(*(F.lag(c, -j).over(spec) for j in range(-before, after + 1))) for i, c in enumerate(columns)}
    held = df.select("*", start.alias("_start"), end.alias("_end"), *(x.alias(name) for name, x in around.items()))
    first, size = (F.lit(before + 1) - F.col("_start")).cast("int"), (F.col("_start") + F.col("_end") + 1).cast("int")
    cut = {f"_in{i}": F.filter(F.when(F.col("_start") + F.col("_end") >= 0, F.slice(f"_near{i}", first, size)), F.isnotnull) for i in range(len(columns))}
    total = []
    for name, (kind, column) in aggregates.items():
        values = F.col(f"_in{columns.index(column)}")
        n = F.greatest(F.size(values), F.lit(0)).cast("bigint")  # of an empty frame null
        value = {"sum": lambda: _added(values, df, column), "count": lambda: n, "avg": lambda: _added(values, df, column).cast("double") / F.nullif(n, F.lit(0)), "min": lambda: F.array_min(values), "max": lambda: F.array_max(values)}[kind]()
        total.append(value.alias(name))
    return held.select("*", *(x.alias(name) for name, x in cut.items())).select("*", *total).drop("_start", "_end", *around, *cut)


def _added(values: Column, df: DataFrame, column: str) -> Column:
    """SUM of an array of column's values without nulls, in the type that sums of blocks have; null if it is empty."""
    kind = df.agg(F.sum(column).alias("s")).agg(F.sum("s")).schema[0].dataType
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast(kind), lambda a, x: (a + x.cast(kind)).cast(kind)))


def moving(df: DataFrame, partition: Sequence[str], by: str | Sequence[str], start: Column, end: Column, aggregates: Mapping[str, tuple[str, str]], frame: str = "rows") -> DataFrame:
    """df with aggregates, name -> (sum, count, avg, min or max, column), over each row's own frame.

    frame "rows": from start rows before the row to end rows after it, in the order of by; keys of partition and
    order should decide the order. frame "range": the rows whose by, one ascending number, lies from start below
    to end above the row's; rows with a null by have an empty frame. Nulls are skipped: a frame without values
    gives null, and count 0. A null bound gives an empty frame.
    """
    names = [by] if isinstance(by, str) else list(by)
    columns = sorted({c for _, c in aggregates.values()})
    spec = over(partition, *names)
    if frame == "rows" and all(kind not in ("sum", "avg") or isinstance(df.select(c).schema[0].dataType, NumericType) for kind, c in aggregates.values()):
        low, high = F.ceil(start).cast("bigint"), F.floor(end).cast("bigint")
        before, after = _reach(df, low, high) or (0, 0)
        if before + after < SHORT:
            return _near(df, spec, low, high, (before, after), aggregates)
    group = F.struct(*(F.col(k).alias(f"p{i}") for i, k in enumerate(partition))) if partition else F.lit(0)
    size = F.count(F.lit(1)).over(W.partitionBy(*partition))
    numbered = df.select(
        F.struct(*df.columns).alias("_doc"), group.alias("_g"), (F.row_number().over(spec) - 1).cast("bigint").alias("_rn"), size.alias("_n"), start.alias("_start"), end.alias("_end"),
        *([F.col(names[0].lstrip("-")).cast("double").alias("_by")] if frame == "range" else []), *(F.col(c).alias(f"_x{i}") for i, c in enumerate(columns)),
    )
    base = materialised(numbered, "frames")
    if frame == "range":
        base = materialised(base.join(_range_bounds(base).hint("merge"), ["_g", "_rn"], "left"), "bounds")
    else:
        base = base.withColumns({"_lo": F.greatest(F.col("_rn") - F.col("_start"), F.lit(0)), "_hi": F.least(F.col("_rn") + F.col("_end") + 1, F.col("_n"))})
        base = base.withColumns({c: F.when(F.col("_start").isNotNull() & F.col("_end").isNotNull(), F.col(c)) for c in ("_lo", "_hi")})
    longest = base.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 0
    levels = max(0, int(longest).bit_length())
    at = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("k")
    parts = base.select("_g", "_rn", *(f"_x{i}" for i in range(len(columns))), at).withColumn("b", F.floor(F.col("_rn") / F.pow(F.lit(2), F.col("k"))).cast("bigint"))
    made = [m for i in range(len(columns)) for m in (F.count(f"_x{i}").alias(f"n{i}"), F.min(f"_x{i}").alias(f"lo{i}"), F.max(f"_x{i}").alias(f"hi{i}"))]
    sums = {i: F.sum(f"_x{i}").alias(f"s{i}") for i, c in enumerate(columns) if any(kind in ("sum", "avg") and of == c for kind, of in aggregates.values())}
    blocks = parts.groupBy("_g", "k", "b").agg(*made, *sums.values())
    wanted = base.select("_g", "_rn", F.explode(_blocks(F.col("_lo"), F.col("_hi"), levels)).alias("block")).select("_g", "_rn", "block.k", "block.b")
    found = wanted.join(blocks.hint("merge"), ["_g", "k", "b"]).groupBy("_g", "_rn")
    total = []
    for name, (kind, column) in aggregates.items():
        i = columns.index(column)
        value = {"sum": lambda i=i: F.sum(f"s{i}"), "count": lambda i=i: F.sum(f"n{i}"), "avg": lambda i=i: F.sum(f"s{i}").cast("double") / F.nullif(F.sum(f"n{i}"), F.lit(0)), "min": lambda i=i: F.min(f"lo{i}"), "max": lambda i=i: F.max(f"hi{i}")}[kind]()
        total.append(value.alias(name))
    out = base.join(found.agg(*total).hint("merge"), ["_g", "_rn"], "left")
    return out.select("_doc.*", *(F.coalesce(F.col(n), F.lit(0)).alias(n) if kind == "count" else F.col(n) for n, (kind, _) in aggregates.items()))


__all__ = ["keys", "moving"]
