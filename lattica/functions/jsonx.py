"""JSON functions with the dialect's clauses. Documents are text; paths are $, .key, [i] and [*] steps."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.compat import value

STEP = re.compile(r"\.(?:\"([^\"]+)\"|([A-Za-z_$][\w$]*))|\[\s*(\d+|\*)\s*\]")


def steps(path: str) -> list[str | int]:
    """The path's steps: a name, an index or * for all elements."""
    if not path.startswith("$") or len(path) > 256:
        raise ValueError(f"{path!r} isn't a path")
    out: list[str | int] = []
    at = 1
    while at < len(path):
        m = STEP.match(path, at)
        if not m or len(out) >= 32:
            raise ValueError(f"{path!r} isn't a path")
        out.append(m[1] or m[2] or ("*" if m[3] == "*" else int(m[3])))
        at = m.end()
    return out


def is_json(s: Column) -> Column:
    return F.when(s.isNotNull(), F.try_parse_json(s).isNotNull())


def _found(s: Column, path: str) -> Column:
    steps(path)
    return F.get_json_object(s, path)


def _kind(s: Column, path: str) -> Column:
    """The type of what the path leads to, or null; a JSON null is VOID."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(s), path, "variant"))


def json_value(s: Column, path: str, returning: str = "string", on_error: str = "null", on_empty: str | None = None) -> Column:
    """The scalar at the path. Objects, arrays and text that isn't JSON are errors; on_empty follows on_error if left out."""
    found = _found(s, path)
    compound = found.rlike(r"^\s*[\[{]") & F.try_parse_json(found).isNotNull()
    wrong = F.try_parse_json(s).isNull() | F.coalesce(compound, F.lit(False))
    result = F.when(s.isNotNull() & ~wrong, found.try_cast(returning))
    if (on_empty or on_error) == "error":
        result = F.when(s.isNotNull() & ~wrong & found.isNull(), F.raise_error(F.lit("no value at the path")).cast(returning)).otherwise(result)
    if on_error == "error":
        result = F.when(s.isNotNull() & wrong, F.raise_error(F.lit("no scalar at the path")).cast(returning)).otherwise(result)
    return result


def json_query(s: Column, path: str, wrapper: str = "without", on_error: str = "null") -> Column:
    """The object or array at the path; with a wrapper also scalars, in brackets (conditional: only those)."""
    found = _found(s, path)
    compound = F.coalesce(found.rlike(r"^\s*[\[{]"), F.lit(False))
    literal = F.when(F.coalesce(_kind(s, path) == "STRING", F.lit(False)), F.to_json(F.array(found)).substr(F.lit(2), F.length(F.to_json(F.array(found))) - 2)).otherwise(found)
    wrapped = F.concat(F.lit("["), F.when(compound, found).otherwise(literal), F.lit("]"))
    good = {"without": F.when(compound, found), "with": F.when(found.isNotNull(), wrapped), "conditional": F.when(compound, found).when(found.isNotNull(), wrapped)}[wrapper]
    other = {"null": F.lit(None).cast("string"), "empty": F.lit("[]"), "[]": F.lit("[]"), "{}": F.lit("{}"), "error": F.raise_error(F.lit("no object or array at the path")).cast("string")}[on_error]
    return F.when(s.isNull(), None).when(good.isNotNull(), good).otherwise(other)


def json_exists(s: Column, path: str = "$") -> Column:
    """Whether the path leads anywhere; a JSON null is something."""
    steps(path)
    return F.when(s.isNotNull(), F.coalesce(F.try_variant_get(F.try_parse_json(s), path, "variant").isNotNull() | F.get_json_object(s, path).isNotNull(), F.lit(False)))


def json_array(*items, absent_on_null: bool = True) -> Column:
    """Items of one type; nulls are left out unless absent_on_null is off."""
    made = F.array(*map(value, items)) if items else F.array()
    return F.to_json(F.array_compact(made) if absent_on_null and items else made)


def json_object(*pairs, absent_on_null: bool = False) -> Column:
    """Names and values in turn; nulls stay unless absent_on_null is on."""
    fields = [value(v).alias(k) for k, v in zip(pairs[::2], pairs[1::2], strict=True)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true" if absent_on_null else "false"})


def json_array_length(s: Column) -> Column:
    return F.json_array_length(s)


def merged(target, patch):
    """A merge patch applied: members that are null in the patch go."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out.get(k), v)
    return out


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def json_mergepatch(target: pd.Series, patch: pd.Series) -> pd.Series:
    def one(t, p):
        try:
            return None if t is None or p is None else _dump(merged(json.loads(t), json.loads(p)))
        except ValueError:
            return None

    return pd.Series([one(t, p) for t, p in zip(target, patch, strict=True)], dtype=object)


def json_set(s: Column, path: str, new: Column, create: bool = True) -> Column:
    """The document with the JSON text new at the path; a missing last step is created unless create is off."""
    way = steps(path)

    @F.pandas_udf(T.StringType())
    def put(texts: pd.Series, news: pd.Series) -> pd.Series:
        def one(t, n):
            try:
                doc, val = json.loads(t), json.loads(n)
            except (TypeError, ValueError):
                return t
            if not way:
                return _dump(val)
            at = doc
            for k in way[:-1]:
                if isinstance(at, dict) and k in at or isinstance(at, list) and isinstance(k, int) and k < len(at):
                    at = at[k]
                else:
                    return _dump(doc)
            last = way[-1]
            if isinstance(at, dict) and isinstance(last, str) and (last in at or create):
                at[last] = val
            elif isinstance(at, list) and isinstance(last, int):
                if last < len(at):
                    at[last] = val
                elif create:
                    at.append(val)
            return _dump(doc)

        return pd.Series([one(t, n) for t, n in zip(texts, news, strict=True)], dtype=object)

    return put(s, new)
