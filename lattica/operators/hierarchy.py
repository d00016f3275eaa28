"""Hierarchical queries: START WITH ... CONNECT BY PRIOR id = parent, level by level."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.ordering import order_by
from lattica.sources.scratch import materialised


Name = Callable[[str], Column]


class CycleError(ValueError):
    """A row is its own ancestor and NOCYCLE wasn't asked for."""


def connect_by(df: DataFrame, id: str | Sequence[str], parent: str | Sequence[str], start_with: Column, path_of: str | None = None, separator: str = "/", order_siblings: Sequence[str] = (), nocycle: bool = False, levels: int | None = None, also: Callable[[Name, Name], Column] | None = None) -> DataFrame:
    """df's rows in the tree with level, root, connect_by_isleaf, connect_by_iscycle, path and sibling_path.

    One equi-join a level, of the last level's rows with the table; each level is written once to the shared
    folder, so plans don't grow with depth, and the first empty one ends it. A row whose id is
    among its ancestors' closes a cycle: with nocycle it is left out and the ancestor that leads to it is
    marked, otherwise it raises. sibling_path orders the rows depth first, siblings by order_siblings or id:
    sort by it. With levels, a deeper tree raises. Several PRIOR terms are lists of equal length; also gives the rest of the
    condition from what names a column of the prior row and what names one of its child's. A WHERE belongs behind this call: it takes out rows, not what hangs below them.
    """
    ids, parents = ([c] if isinstance(c, str) else list(c) for c in (id, parent))
    named = F.col(path_of or ids[0]).cast("string")
    rank = F.struct(*(F.col(c) for c in (*order_siblings, *ids)))
    key, child_key = F.col(ids[0]), F.col(f"_c_{ids[0]}")
    if len(ids) > 1:
        key, child_key = F.struct(*ids), F.struct(*(F.col(f"_c_{c}").alias(c) for c in ids))
    base = df.withColumns({"_name": named, "_rank": rank})
    front = base.filter(start_with).select(
        *df.columns, F.lit(1).alias("level"), key.alias("root"), F.concat(F.lit(separator), "_name").alias("path"), F.array(key).alias("_ids"), F.array("_rank").alias("sibling_path")
    )
    children = base.select(*(F.col(c).alias(f"_c_{c}") for c in df.columns), F.col("_name").alias("_cn"), F.col("_rank").alias("_cr"))
    below = reduce(lambda a, b: a & b, (F.col(i) == F.col(f"_c_{p}") for i, p in zip(ids, parents, strict=True)))
    if also is not None:
        below = below & also(F.col, lambda c: F.col(f"_c_{c}"))
    front = materialised(front, "level")
    found, cyclic = front, None
    for depth in count(1):
        joined = front.join(children, below)
        again = F.array_contains("_ids", child_key)
        closing = joined.filter(again).select("_ids")
        if closing.limit(1).count():
            if not nocycle:
                raise CycleError(f"a cycle in {parent}")
            cyclic = closing if cyclic is None else cyclic.unionAll(closing)
        front = joined.filter(~again).select(
            *(F.col(f"_c_{c}").alias(c) for c in df.columns), (F.col("level") + 1).alias("level"), "root", F.concat("path", F.lit(separator), "_cn").alias("path"),
            F.concat("_ids", F.array(child_key)).alias("_ids"), F.concat("sibling_path", F.array("_cr")).alias("sibling_path"),
        )
        front = materialised(front, "level")
        if not front.limit(1).count():
            break
        if depth == levels:
            raise ValueError(f"more than {levels} levels")
        found = found.unionAll(front)
    inner = found.select(F.slice("_ids", F.lit(1), F.size("_ids") - 1).alias("_p")).filter(F.size("_p") > 0).distinct().withColumn("_inner", F.lit(1))
    out = found.join(inner, F.col("_ids") == F.col("_p"), "left")
    if cyclic is not None:
        out = out.join(cyclic.select(F.col("_ids").alias("_cy")).distinct(), F.col("_ids") == F.col("_cy"), "left")
        flag = F.col("_cy").isNotNull().cast("int")
    else:
        flag = F.lit(0)
    return out.withColumns({"connect_by_isleaf": F.col("_inner").isNull().cast("int"), "connect_by_iscycle": flag}).drop("_p", "_inner", "_cy", "_ids")


def depth_first(tree: DataFrame) -> DataFrame:
    return order_by(tree, "sibling_path")


def generate(df: DataFrame, count: Column | int, name: str = "level") -> DataFrame:
    """CONNECT BY ROWNUM <= count: each row of df with the numbers 1 to count."""
    n = F.lit(count) if isinstance(count, int) else count
    return df.withColumn(name, F.explode(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
