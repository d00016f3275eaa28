"""JSON_TABLE: rows from JSON text, beside the columns of the row that holds it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import jsonx


def json_table(df: DataFrame, json: str, row_path: str, columns: Mapping[str, tuple[str, str]], outer: bool = False, ordinality: str | None = None, on_error: str = "null") -> DataFrame:
    """COLUMNS as name -> (kind, path): kind is a type, "exists" or "query". A row_path that ends in [*] gives a row for
    each element, any other one row; outer keeps rows of df that give none. NESTED PATH is a second call over a "query"
    column. on_error is "null" or "error", for values that aren't what their column asks for."""
    steps = jsonx.steps(row_path)
    if steps and steps[-1] == "*":
        found = F.get_json_object(F.col(json), row_path[: row_path.rindex("[")])
        items = F.transform(F.from_json(found, "array<string>"), lambda x: x)
    else:
        one = F.get_json_object(F.col(json), row_path)
        items = F.when(one.isNotNull(), F.array(one))
    explode = F.posexplode_outer if outer else F.posexplode
    rows = df.select("*", explode(items).alias("_pos", "_item"))

    def made(kind: str, path: str) -> Column:
        item = F.col("_item")
        if kind == "exists":
            return jsonx.json_exists(item, path).cast("int")
        if kind == "query":
            return jsonx.json_query(item, path)
        if path == "$":
            return item.cast(kind) if on_error == "error" else item.try_cast(kind)
        return jsonx.json_value(item, path, kind, on_error=on_error, on_empty="null")

    out = rows.withColumns({n: made(k, p) for n, (k, p) in columns.items()})
    return (out.withColumn(ordinality, F.col("_pos") + 1) if ordinality else out).drop("_pos", "_item")
