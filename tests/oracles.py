"""Comparing a query's rows with what DuckDB gives for its SQL."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if x is None or isinstance(x, str | bool):
        return x
    if isinstance(x, Decimal | float | int):
        x = float(x)
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat() + "T00:00:00"
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if isinstance(x, bytes | bytearray):
        return bytes(x).hex()
    return str(x)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str, ordered: bool = False) -> str:
    """What differs, or an empty string. ordered: rows are compared in their order, columns by name."""
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    there, here = found.fetchall(), df.collect()
    if ordered:
        for at, (a, b) in enumerate(zip(here, there, strict=False)):
            if rows_of(df.columns, [a]) != rows_of(columns, [b]):
                return f"row {at}: {a} and {b}"
    want, got = rows_of(columns, there), rows_of(df.columns, here)
    if want == got:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
