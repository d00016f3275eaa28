"""Dialect rules that differ from Spark's defaults, as functions from columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def value(x) -> Column:
    """A column as it is, anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def asc(x: Column | str) -> Column:
    """Ascending, nulls last."""
    return col(x).asc_nulls_last()


def desc(x: Column | str) -> Column:
    """Descending, nulls first."""
    return col(x).desc_nulls_first()


def cat(*parts: Column) -> Column:
    """Concatenation that takes null as empty; null only if all parts are null."""
    return F.when(F.coalesce(*(value(p).cast("string") for p in parts)).isNotNull(), F.concat_ws("", *(value(p).cast("string") for p in parts)))


def mod(x: Column, y: Column) -> Column:
    """The remainder with the sign of x; x itself if y is zero."""
    return F.when(value(y) == 0, x).otherwise(F.try_mod(x, value(y)))


def divide(x: Column, y: Column, zero_is_null: bool = False) -> Column:
    """Division of numbers as doubles; by zero it raises, or gives null."""
    a, b = value(x).cast("double"), value(y).cast("double")
    return F.try_divide(a, b) if zero_is_null else a / b


def _unless_null(args, result: Column) -> Column:
    some = F.lit(False)
    for a in args:
        some = some | a.isNull()
    return F.when(~some, result)


def greatest(*args: Column) -> Column:
    """The greatest argument; null if any is null."""
    return value(args[0]) if len(args) == 1 else _unless_null(list(map(value, args)), F.greatest(*map(value, args)))


def least(*args: Column) -> Column:
    return value(args[0]) if len(args) == 1 else _unless_null(list(map(value, args)), F.least(*map(value, args)))


def decode(x: Column, *rest) -> Column:
    """Pairs of search and result, then perhaps a default; null matches null."""
    pairs, default = list(zip(rest[::2], rest[1::2], strict=False)), rest[-1] if len(rest) % 2 else None
    out = F.lit(None) if default is None else value(default)
    for search, result in reversed(pairs):
        out = F.when(x.eqNullSafe(value(search)), value(result)).otherwise(out)
    return out


def nvl(x: Column, y) -> Column:
    return F.coalesce(x, value(y))


def nvl2(x: Column, y, z) -> Column:
    return F.when(x.isNotNull(), value(y)).otherwise(value(z))


def lnnvl(condition: Column) -> Column:
    """True where the condition is false or unknown."""
    return ~F.coalesce(condition, F.lit(False))


def empty_as_null(x: Column) -> Column:
    """For sessions in which the empty string is null."""
    return F.when(x != "", x)


def sum_number(x: Column) -> Column:
    """SUM with the dialect's result type: integers add up to a number of 38 digits."""
    return F.sum(x.cast("decimal(38,0)"))


def spread(x: Column, aggregate) -> Column:
    """STDDEV or VARIANCE of the dialect: zero for a single value, where Spark gives null."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(aggregate(x))


def stddev(x: Column) -> Column:
    return spread(x, F.stddev_samp)


def variance(x: Column) -> Column:
    return spread(x, F.var_samp)


def sort_keys(by) -> list[tuple[Column, bool]]:
    """(column, descending) of one sort key or a list of them: a column, a name (a leading minus means descending) or a pair of column and descending."""
    out = []
    for key in by if isinstance(by, list) else [by]:
        column, down = key if isinstance(key, tuple) else (key, False)
        if isinstance(column, str) and column.startswith("-"):
            column, down = column[1:], True
        out.append((col(column), down))
    return out


def group_concat(x: Column, separator: str = ",", order=None) -> Column:
    """The group's values in the order of one key or a list of them (see sort_keys(); their own order by default); nulls are
    skipped, and the result is null only if all values are."""
    by = sort_keys(x if order is None else order)
    entry = F.struct(*(k.alias(f"k{i}") for i, (k, _) in enumerate(by)), x.cast("string").alias("v"))
    held = F.collect_list(F.when(x.isNotNull(), entry))

    def compare(a: Column, b: Column) -> Column:
        out = F.when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0)
        for i, (_, down) in reversed(list(enumerate(by))):
            p, q, late = a[f"k{i}"], b[f"k{i}"], -1 if down else 1  # nulls come last ascending and first descending
            out = F.when(p.isNull() & q.isNull(), out).when(p.isNull(), late).when(q.isNull(), -late).when(p < q, -late).when(p > q, late).otherwise(out)
        return out

    return F.when(F.size(held) > 0, F.array_join(F.transform(F.array_sort(held, compare), lambda s: s["v"]), separator))


def _stands_before(v, by, itself: bool = False) -> Column:
    """Whether a row sorts before the values given for the sort keys (or, with itself, with them)."""
    out = F.lit(itself)
    for (key, down), one in reversed(list(zip(sort_keys(by), v if isinstance(v, list) else [v], strict=True))):
        wanted = value(one)
        less = F.when(key.isNull() & wanted.isNull(), False).when(key.isNull(), down).when(wanted.isNull(), not down).otherwise(key > wanted if down else key < wanted)
        out = less | (key.eqNullSafe(wanted) & out)
    return out


def rank_of(v, key) -> Column:
    """RANK(v) WITHIN GROUP (ORDER BY key): where v would stand. Several keys and their values are lists; see sort_keys() for descending ones."""
    return F.count_if(_stands_before(v, key)) + 1


def dense_rank_of(v, key) -> Column:
    return F.count_distinct(F.when(_stands_before(v, key), F.struct(*(k for k, _ in sort_keys(key))))) + 1


def cume_dist_of(v, key) -> Column:
    """CUME_DIST(v) WITHIN GROUP (ORDER BY key), with v counted in."""
    return (F.count_if(_stands_before(v, key, itself=True)) + 1) / (F.count(F.lit(1)) + 1)


def number(x) -> Column:
    """A number, or the number that a text stands for; text that is none raises."""
    return value(x).cast("decimal(38,10)")


def arithmetic(op: str, a, b) -> Column:
    """a op b for +, -, * or /, of numbers or of texts that stand for numbers."""
    x, y = number(a), number(b)
    return {"+": x + y, "-": x - y, "*": x * y, "/": x / y}[op]


def compare(op: str, a, b) -> Column:
    """a op b for =, <>, <, <=, > or >=, where one side may be a text that stands for a number. Two texts compare as numbers too."""
    x, y = number(a), number(b)
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def nulls_for_empty(df):
    """df with null for the empty string in every text column: what a session with EMPTY_STRING_AS_NULL reads."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: empty_as_null(F.col(c)) for c in texts})
