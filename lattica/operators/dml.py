"""Changes as images: each function gives the table's new rows, to be written in place of the old ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.operators.ordering import keys


def merge(target: DataFrame, source: DataFrame, on: Sequence[str], update: Mapping[str, Column] | None = None, insert: Mapping[str, Column] | None = None, update_where: Column | None = None, insert_where: Column | None = None, delete_where: Column | None = None, unique: bool = False) -> DataFrame:
    """MERGE INTO target USING source ON equal keys, by one full outer join.

    Expressions name columns as t.x and s.x. Matched rows are updated where update_where holds and then
    deleted where delete_where does, which sees the row before the update; source rows without a match are
    inserted. A target row that several source rows match makes the job fail, as does, with unique, any key that the
    source repeats; see latest() for choosing one row of each first.
    """
    counted = source.withColumn("_s", F.count(F.lit(1)).over(W.partitionBy(*on)))
    t, s = target.withColumn("_t", F.lit(1)).alias("t"), counted.alias("s")
    both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on], "full")
    had, got = F.col("_t").isNotNull(), F.col("_s").isNotNull()
    change = had & got & (update_where if update_where is not None else F.lit(update is not None))
    out = {}
    for c in target.columns:
        kind = target.schema[c].dataType
        old = F.col(f"t.{c}")
        new = F.when(F.coalesce(change, F.lit(False)), update[c].cast(kind)).otherwise(old) if update and c in update else old
        out[c] = F.when(had, new).otherwise(insert[c].cast(kind) if insert and c in insert else F.lit(None).cast(kind))
    keep = had & ~F.coalesce((got & delete_where) if delete_where is not None else F.lit(False), F.lit(False))
    add = ~had & F.coalesce(insert_where if insert_where is not None else F.lit(True), F.lit(False)) if insert is not None else F.lit(False)
    repeated = (got & (F.col("_s") > 1)) if unique else (had & got & (F.col("_s") > 1))
    sure = F.when(F.coalesce(repeated, F.lit(False)), F.raise_error(F.lit("the source has several rows for one key of the target")).cast("boolean")).otherwise(F.lit(True))
    return both.filter(F.when(sure, keep | add)).select(*(x.alias(c) for c, x in out.items()))


def upsert(target: DataFrame, rows: DataFrame, on: Sequence[str], update: Mapping[str, Column] | None = None) -> DataFrame:
    """INSERT ... ON DUPLICATE KEY UPDATE; without update, REPLACE INTO: the new row wins."""
    changed = update or {c: F.col(f"s.{c}") for c in target.columns if c not in on}
    return merge(target, rows, on, update=changed, insert={c: F.col(f"s.{c}") for c in target.columns}, unique=True)


def update(target: DataFrame, set: Mapping[str, Column], where: Column) -> DataFrame:
    """Every right side sees the old row; where it is unknown nothing changes."""
    hit = F.coalesce(where, F.lit(False))
    return target.select(*(F.when(hit, set[c].cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in set else F.col(c) for c in target.columns))


def update_first(target: DataFrame, set: Mapping[str, Column], where: Column, by: Sequence[str], count: int, key: Sequence[str]) -> DataFrame:
    """UPDATE ... ORDER BY ... LIMIT count: the keys of the rows that change are a top-N."""
    some = target.filter(where).orderBy(*keys(*by)).limit(count).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).withColumn("_hit", F.lit(True))
    marked = target.join(some, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(key)], "left")
    return update(marked, set, F.col("_hit")).select(*target.columns)


def update_from(target: DataFrame, source: DataFrame, on: Sequence[str], set: Mapping[str, Column]) -> DataFrame:
    """UPDATE with a join: set names columns as t.x and s.x; the source's keys have to be distinct."""
    return merge(target, source, on, update=set)


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.filter(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, on: Sequence[str]) -> DataFrame:
    return target.join(source.select(*on), list(on), "left_anti")


def delete_first(target: DataFrame, where: Column, by: Sequence[str], count: int, key: Sequence[str]) -> DataFrame:
    """DELETE ... ORDER BY ... LIMIT count: the keys of the rows that go are a top-N."""
    gone = target.filter(where).orderBy(*keys(*by)).limit(count).select(*key)
    return target.join(gone, list(key), "left_anti")


def returning(before: DataFrame, where: Column, *columns: str | Column) -> DataFrame:
    """RETURNING of an UPDATE or DELETE: what the rows that it meets give, evaluated before it is written."""
    return before.filter(where).select(*columns)


def insert_all(source: DataFrame, *branches: tuple[Column | None, Sequence[Column]], first: bool = False) -> list[DataFrame]:
    """INSERT ALL: the rows that each branch (condition, columns) takes; with first, only the first branch that holds."""
    out, taken = [], F.lit(False)
    for condition, columns in branches:
        hit = F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(True)
        out.append(source.filter(hit & ~taken if first else hit).select(*columns))
        taken = taken | hit
    return out


def latest(df: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row for each key, the first in the given order; for sources with repeated keys before merge()."""
    spec = W.partitionBy(*on).orderBy(*keys(*by))
    return df.withColumn("_n", F.row_number().over(spec)).filter("_n = 1").drop("_n")
