"""The dialect's function names and what makes each: dialect(name) gives the builder.

Names that stand for state of a session, a transaction or a cluster have no meaning over immutable files;
asking for one raises Unsupported rather than giving a made-up value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import compat, dates, jsonx, misc, strings

VERSION = "lattica 1"


class Unsupported(NotImplementedError):
    """The function needs state that an analytics engine doesn't hold."""


def to_char(x: Column, fmt: str | None = None) -> Column:
    """TO_CHAR of a number or a date, told apart by the format, if any: only a number's has digits alone."""
    return misc.number_text(x, fmt) if fmt is None or not set(fmt.upper()) - set("09.,SMIPR$ ") else dates.to_char(x, fmt)


MATH = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "atan2": F.atan2, "bitand": lambda a, b: a.bitwiseAND(b), "bitor": lambda a, b: a.bitwiseOR(b),
    "bitxor": lambda a, b: a.bitwiseXOR(b), "ceil": F.ceil, "cos": F.cos, "exp": F.exp, "floor": F.floor, "ln": F.ln, "log": misc.log, "mod": compat.mod, "pi": F.pi,
    "power": F.power, "radians": F.radians, "rand": misc.rand, "round": lambda x, n=0: dates.round_date(x, n) if isinstance(n, str) else misc.round_number(x, n), "sign": F.signum, "sin": F.sin, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh, "trunc": lambda x, n=0: dates.trunc(x, n) if isinstance(n, str) else misc.trunc_number(x, n),
}
STRING = {
    "ascii": F.ascii, "asciistr": strings.asciistr, "char": F.char, "char_length": F.char_length, "chr": F.char, "concat": compat.cat, "concat_ws": F.concat_ws, "find_in_set": strings.find_in_set,
    "insert": strings.insert, "instr": strings.instr, "instrb": strings.instrb, "isnumeric": strings.isnumeric, "left": F.left, "length": F.char_length, "lengthb": strings.lengthb, "locate": F.locate,
    "lower": F.lower, "lpad": F.lpad, "ltrim": lambda s, c=" ": strings.trim_set(s, c, "leading"), "repeat": F.repeat, "replace": strings.replace, "reverse": F.reverse, "right": F.right, "rpad": F.rpad,
    "rtrim": lambda s, c=" ": strings.trim_set(s, c, "trailing"), "soundex": strings.soundex, "space": lambda n: F.repeat(F.lit(" "), n), "substr": strings.substr, "substrb": strings.substrb,
    "substring": strings.substr, "substring_index": strings.substring_index, "to_multi_byte": strings.to_multi_byte, "to_single_byte": strings.to_single_byte, "translate": F.translate,
    "trim": strings.trim_set, "upper": F.upper, "vsize": strings.lengthb,
}
REGEX = {"regexp_count": strings.regexp_count, "regexp_instr": strings.regexp_instr, "regexp_replace": strings.regexp_replace, "regexp_substr": strings.regexp_substr}
DATE = {
    "add_months": dates.add_months, "current_timestamp": F.current_timestamp, "extract": lambda unit, x: F.extract(F.lit(unit), x), "from_tz": dates.from_tz, "from_unixtime": dates.from_unixtime,
    "getutcdate": dates.utc_now, "last_day": dates.last_day, "localtimestamp": F.localtimestamp, "months_between": dates.months_between, "next_day": dates.next_day, "now": F.now,
    "numtodsinterval": dates.numtodsinterval, "numtoyminterval": dates.numtoyminterval, "systimestamp": F.current_timestamp, "sys_extract_utc": dates.sys_extract_utc, "timestampadd": dates.timestampadd,
    "timestampdiff": dates.timestampdiff, "to_dsinterval": dates.to_dsinterval, "to_yminterval": dates.to_yminterval, "unix_timestamp": F.unix_timestamp, "utc_date": dates.utc_now, "utc_timestamp": dates.utc_now,
}
CONVERSION = {
    "bin2hex": misc.bin2hex, "cast": lambda x, kind: x.cast(kind), "convert": lambda x, kind: x.cast(kind), "empty_blob": lambda: F.lit(b""), "empty_clob": lambda: F.lit(""), "hex": F.hex, "hex2bin": F.unhex,
    "hextoraw": F.unhex, "inet_aton": misc.inet_aton, "inet_ntoa": misc.inet_ntoa, "rawtohex": F.hex, "to_blob": lambda x: x.cast("binary"), "to_char": lambda x, fmt=None: to_char(x, fmt), "to_clob": lambda x: x.cast("string"),
    "to_date": dates.to_date, "to_nchar": lambda x, fmt=None: to_char(x, fmt), "to_number": misc.to_number, "to_timestamp": dates.to_timestamp, "unhex": F.unhex,
}
CONDITIONAL = {
    "coalesce": F.coalesce, "decode": compat.decode, "greatest": compat.greatest, "if": lambda c, a, b: F.when(c, a).otherwise(b), "ifnull": compat.nvl, "least": compat.least, "lnnvl": compat.lnnvl,
    "nullif": F.nullif, "nvl": compat.nvl, "nvl2": compat.nvl2,
}
JSON = {
    "json_array": jsonx.json_array, "json_array_length": jsonx.json_array_length, "json_exists": jsonx.json_exists, "json_mergepatch": jsonx.json_mergepatch, "json_object": jsonx.json_object,
    "json_query": jsonx.json_query, "json_set": jsonx.json_set, "json_value": jsonx.json_value,
    "jsonb_array_length": jsonx.json_array_length, "jsonb_exists": jsonx.json_exists, "jsonb_mergepatch": jsonx.json_mergepatch, "jsonb_query": jsonx.json_query, "jsonb_set": jsonx.json_set, "jsonb_value": jsonx.json_value,
}
AGGREGATE = {
    "approx_count_distinct": F.approx_count_distinct, "array_agg": F.collect_list, "avg": F.avg, "corr": F.corr, "count": F.count, "covar_pop": F.covar_pop, "covar_samp": F.covar_samp,
    "cume_dist": compat.cume_dist_of, "dense_rank": compat.dense_rank_of, "grouping": F.grouping, "grouping_id": F.grouping_id, "group_concat": compat.group_concat,
    "listagg": lambda x, separator="", order=None: compat.group_concat(x, separator, order), "max": F.max, "median": F.median, "min": F.min, "rank": compat.rank_of, "stddev": compat.stddev,
    "stddev_pop": F.stddev_pop, "stddev_samp": F.stddev_samp, "sum": F.sum, "variance": compat.variance, "var_pop": F.var_pop, "var_samp": F.var_samp,
}
MISC = {
    "array_length": misc.array_length, "ct_hash": misc.ct_hash, "hash": F.xxhash64, "md5": F.md5, "sha": F.sha1, "sha1": F.sha1, "sys_guid": misc.sys_guid, "uuid": F.uuid, "version": lambda: F.lit(VERSION),
    "sys_context": misc.sys_context, "userenv": lambda name: misc.sys_context("USERENV", name),
}
#: found_rows is df.count() before the limit, sys_connect_by_path the path of connect_by(), values the s.x of upsert().
ELSEWHERE = {"found_rows": "DataFrame.count", "sys_connect_by_path": "lattica.operators.hierarchy.connect_by", "values": "lattica.operators.dml.upsert"}
UNSUPPORTED = frozenset(
    "gscn2date scn2date type_id2name connection_id get_lock get_shared_lock get_xact_lock get_xact_shared_lock last_insert_id object_id page_masterid release_lock release_shared_lock serial_lastval try_get_lock try_get_shared_lock try_get_xact_lock try_get_xact_shared_lock updating".split()
)

FUNCTIONS: dict[str, Callable[..., Column]] = {**MATH, **STRING, **REGEX, **DATE, **CONVERSION, **CONDITIONAL, **JSON, **AGGREGATE, **MISC}


#: What the names that take numbers and dates do with a date.
OF_DATES = {"round": dates.round_date, "trunc": dates.trunc, "to_char": dates.to_char, "to_nchar": dates.to_char}
ALIASES: dict[str, str] = {}


@contextmanager
def aliases(names: Mapping[str, str]) -> Iterator[None]:
    """Other names for functions, as a configuration lists them: name -> the dialect's name. They hold inside of the with block."""
    added = {k.lower(): v.lower() for k, v in names.items()}
    if clash := [k for k in added if k in FUNCTIONS]:
        raise ValueError(f"{clash[0]} is a function's own name")
    before = dict(ALIASES)
    ALIASES.update(added)
    try:
        yield
    finally:
        ALIASES.clear()
        ALIASES.update(before)


def dialect(name: str, df: DataFrame | None = None) -> Callable[..., Column]:
    """The builder of a function. ROUND, TRUNC and TO_CHAR go by their argument's type in df, if that is given, and else by
    their format: without one they take a number."""
    key = ALIASES.get(name.lower(), name.lower())
    if df is not None and key in OF_DATES:
        return lambda x, *rest: (OF_DATES[key] if df.select(x).schema[0].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else FUNCTIONS[key])(x, *rest)
    if key in FUNCTIONS:
        return FUNCTIONS[key]
    if key in ELSEWHERE:
        raise Unsupported(f"{name} isn't an expression here: see {ELSEWHERE[key]}")
    if key in UNSUPPORTED:
        raise Unsupported(f"{name} needs session, lock or cluster state")
    raise KeyError(name)
