"""Reading tables, joining past hot keys and running Arrow batches over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.scratch import materialised, shared_dir
from lattica.sources.tables import load as table

__all__ = ["bounded_sample", "fold", "in_batches", "join_groups", "materialised", "shared_dir", "table"]

#: Keys with over 1/HOT_SHARE of a table's rows are joined by broadcast; there are at most HOT_SHARE of them.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per key, where a few keys may hold most rows.

    size: the column of groups with the key's row count; total: the sum of it. Groups over 1/HOT_SHARE of
    the total, of which there can be no more than HOT_SHARE, are broadcast, so their rows stay where they
    are. All others are joined by a shuffle in which no key has more than that share.
    """
    limit = max(1, total // HOT_SHARE)
    hot, cold = groups.filter(F.col(size) > limit), groups.filter(F.col(size) <= limit)
    few = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(few, key, "left_anti").join(cold, key))


def in_batches(df: DataFrame, columns: Sequence[str | Column], fn: Callable[..., dict], schema: str, passed: Sequence[str] = ()) -> DataFrame:
    """Run fn over Arrow batches. fn gets a list for each of the columns and returns a list or array for each name in
    schema that isn't in passed; the passed columns go through as they are."""
    chosen = df.select(*columns)
    names = [c for c in chosen.columns if c not in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in passed] + [x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=[*passed, *out])

    return chosen.mapInArrow(run, schema)


def fold(column: str, parts: int) -> Column:
    """CRC-32 of the id as text, modulo parts: which fold a row belongs to."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, id: str, rows: int) -> DataFrame:
    """About that many rows of df, or all if there are no more: those whose hashed id is low enough. Nothing is shuffled."""
    n = df.count()
    return df if n <= rows else df.filter(F.pmod(F.xxhash64(id, F.lit("sample")), F.lit(1 << 40)) < int(rows / n * (1 << 40)))
