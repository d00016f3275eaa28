"""Dates of the dialect: a DATE has a time of day and is a timestamp without zone here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.compat import value

DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, its wall clock taken as UTC."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def add_days(ts: Column, days) -> Column:
    """ts plus a number of days, fractions included."""
    d = value(days).cast("double")
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(d * 86400, 6).cast("decimal(18,6)"))


def days_between(a: Column, b: Column) -> Column:
    """a minus b as a number of days."""
    return F.timestamp_diff("MICROSECOND", b, a) / F.lit(float(DAY_US))


def with_time_of(day: Column, ts: Column) -> Column:
    """The date of the first with the time of day of the second."""
    return day.cast("timestamp") + (ts - F.date_trunc("DAY", ts))


def add_months(ts: Column, n) -> Column:
    """Month ends stay month ends; otherwise the day is kept or cut to the month's last. Keeps the time of day."""
    day = ts.cast("date")
    moved = F.add_months(day, value(n).cast("int"))
    return with_time_of(F.when(day == F.last_day(day), F.last_day(moved)).otherwise(moved), ts)


def last_day(ts: Column) -> Column:
    return with_time_of(F.last_day(ts.cast("date")), ts)


#: Weekday names by number, Sunday first.
WEEKDAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")


def next_day(ts: Column, weekday: str | int) -> Column:
    """The first such weekday (a name, or 1 for Sunday to 7) after ts, with its time of day."""
    name = WEEKDAYS[weekday - 1] if isinstance(weekday, int) else weekday[:3].upper()
    return with_time_of(F.next_day(ts.cast("date"), name), ts)


def months_between(a: Column, b: Column) -> Column:
    return F.months_between(a, b, roundOff=False)


def timestampdiff(unit: str, a: Column, b: Column) -> Column:
    """From a to b in whole units that have passed, toward zero: months and what is made of them by day and time of the month, the rest by elapsed time."""
    unit = unit.upper()
    if unit in ("YEAR", "QUARTER", "MONTH"):
        return _toward_zero(F.timestamp_diff("MONTH", a, b) / {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[unit])
    if unit in ("WEEK", "DAY"):
        return _toward_zero(F.timestamp_diff("DAY", a, b) / (7 if unit == "WEEK" else 1))
    return F.timestamp_diff(unit, a, b)


def _toward_zero(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")


def timestampadd(unit: str, n, ts: Column) -> Column:
    if unit.upper() in ("MONTH", "QUARTER", "YEAR"):
        return add_months(ts, value(n) * {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit.upper()])
    return F.timestamp_add(unit, value(n), ts)


#: The format elements that name each unit of ROUND and TRUNC.
UNITS = {
    "CC": "CENTURY", "SCC": "CENTURY", "YYYY": "YEAR", "YYY": "YEAR", "YY": "YEAR", "Y": "YEAR", "YEAR": "YEAR", "Q": "QUARTER",
    "MONTH": "MONTH", "MON": "MONTH", "MM": "MONTH", "RM": "MONTH", "WW": "YEARWEEK", "W": "MONTHWEEK", "DDD": "DAY", "DD": "DAY",
    "D": "WEEK", "DY": "WEEK", "DAY": "WEEK", "HH": "HOUR", "HH12": "HOUR", "HH24": "HOUR", "MI": "MINUTE", "SS": "SECOND",
}


def trunc(ts: Column, fmt: str = "DD") -> Column:
    """The start of the century, year, quarter, month, week (Sunday), week of the year or month, day, hour, minute or second."""
    unit = UNITS[fmt.upper()]
    day = F.date_trunc("DAY", ts)
    if unit == "CENTURY":
        return F.make_timestamp(F.floor((F.year(ts) - 1) / 100).cast("int") * 100 + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    if unit == "WEEK":
        return F.date_add(day.cast("date"), 1 - F.dayofweek(ts)).cast("timestamp")
    if unit in ("YEARWEEK", "MONTHWEEK"):
        first = F.date_trunc("YEAR" if unit == "YEARWEEK" else "MONTH", ts).cast("date")
        return F.date_add(first, (F.floor(F.datediff(ts, first) / 7) * 7).cast("int")).cast("timestamp")
    return F.date_trunc(unit, ts)


def round_date(ts: Column, fmt: str = "DD") -> Column:
    """The nearest start of a unit: from the middle on the next one, which is noon, the 16th, July and so on."""
    unit = UNITS[fmt.upper()]
    low = trunc(ts, fmt)
    if unit == "CENTURY":
        return F.when((F.year(ts) - 1) % 100 >= 50, low + F.expr("INTERVAL 100 YEAR")).otherwise(low)
    if unit == "YEAR":
        return F.when(F.month(ts) >= 7, low + F.expr("INTERVAL 1 YEAR")).otherwise(low)
    if unit == "QUARTER":
        second = (F.month(ts) - 1) % 3
        return F.when((second == 2) | (second == 1) & (F.dayofmonth(ts) >= 16), low + F.expr("INTERVAL 3 MONTH")).otherwise(low)
    if unit == "MONTH":
        return F.when(F.dayofmonth(ts) >= 16, low + F.expr("INTERVAL 1 MONTH")).otherwise(low)
    step = {"WEEK": 604_800, "YEARWEEK": 604_800, "MONTHWEEK": 604_800, "DAY": 86_400, "HOUR": 3_600, "MINUTE": 60, "SECOND": 1}[unit]
    passed = F.timestamp_diff("MICROSECOND", low, ts)
    return F.when(passed >= step * 500_000, low + F.expr(f"INTERVAL '{step}' SECOND")).otherwise(low)


#: Format elements and the pattern letters for them, longest first where one starts another.
ELEMENTS = {
    "YYYY": "yyyy", "YYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "MI": "mm", "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "DY": "EEE",
    "HH24": "HH", "HH12": "hh", "HH": "hh", "SSSSS": None, "SS": "ss", "FF6": "SSSSSS", "FF3": "SSS", "FF": "SSSSSS", "AM": "a", "PM": "a", "A.M.": "a", "P.M.": "a",
    "SCC": None, "CC": None, "WW": None, "W": None, "Q": None, "D": None, "RM": None, "Y": None, "TZH": "xx", "TZM": "",
}
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")


def format_parts(fmt: str) -> list[tuple[str, str]]:
    """The format cut into ("element", name) and ("text", literal)."""
    out: list[tuple[str, str]] = []
    i, up = 0, fmt.upper()
    names = sorted(ELEMENTS, key=len, reverse=True)
    while i < len(fmt):
        if fmt[i] == '"':
            j = fmt.index('"', i + 1)
            out.append(("text", fmt[i + 1 : j]))
            i = j + 1
        elif hit := next((n for n in names if up.startswith(n, i)), None):
            out.append(("element", hit))
            i += len(hit)
        else:
            out.append(("text", fmt[i]))
            i += 1
    return out


def _element(ts: Column, name: str) -> Column:
    if name == "YYY" or name == "Y":
        return F.substring(F.date_format(ts, "yyyy"), -len(name), len(name))
    if name in ("MONTH", "MON", "DAY", "DY"):
        return F.upper(F.date_format(ts, ELEMENTS[name]))
    if name == "SSSSS":
        return F.lpad((F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("string"), 5, "0")
    if name in ("CC", "SCC"):
        return F.lpad(F.ceil(F.year(ts) / 100).cast("string"), 2, "0")
    if name == "WW":
        return F.lpad((F.floor((F.dayofyear(ts) - 1) / 7) + 1).cast("string"), 2, "0")
    if name == "W":
        return (F.floor((F.dayofmonth(ts) - 1) / 7) + 1).cast("string")
    if name == "Q":
        return F.quarter(ts).cast("string")
    if name == "D":
        return F.dayofweek(ts).cast("string")
    if name == "RM":
        return F.element_at(F.array(*map(F.lit, ROMAN)), F.month(ts))
    return F.date_format(ts, ELEMENTS[name])


def to_char(ts: Column, fmt: str = "YYYY-MM-DD HH24:MI:SS") -> Column:
    """The date in a format of the dialect's elements; other characters and quoted text stay as they are."""
    return F.concat(*(F.lit(text) if kind == "text" else _element(ts, text) for kind, text in format_parts(fmt)))


def java_pattern(fmt: str) -> str:
    """The format as a pattern that Spark parses with; elements that don't say a date on their own are refused."""
    out = ""
    for kind, text in format_parts(fmt):
        if kind == "text":
            out += f"'{text}'" if text.isalpha() else text
        elif ELEMENTS[text] is None:
            raise ValueError(f"{text} can't be read")
        else:
            out += ELEMENTS[text]
    return out


def to_date(s: Column, fmt: str = "YYYY-MM-DD HH24:MI:SS") -> Column:
    """A timestamp without zone: the time of day is kept."""
    return F.to_timestamp_ntz(s, F.lit(java_pattern(fmt)))


def to_timestamp(s: Column, fmt: str = "YYYY-MM-DD HH24:MI:SS.FF") -> Column:
    return F.to_timestamp_ntz(s, F.lit(java_pattern(fmt)))


#: MySQL-style format letters.
PERCENT = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "h": "hh", "i": "mm", "s": "ss", "M": "MMMM", "b": "MMM", "p": "a", "f": "SSSSSS", "j": "DDD", "W": "EEEE", "a": "EEE", "D": "d", "x": "yyyy"}


def from_unixtime(seconds: Column, fmt: str | None = None) -> Column:
    if fmt is None:
        return F.from_unixtime(seconds)
    java, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            java += PERCENT.get(fmt[i + 1], f"'{fmt[i + 1]}'")
            i += 2
        else:
            java += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return F.from_unixtime(seconds, java)


def numtodsinterval(n: Column, unit: str) -> Column:
    seconds = value(n).cast("double") * {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}[unit.upper()]
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(seconds, 6).cast("decimal(18,6)"))


def numtoyminterval(n: Column, unit: str) -> Column:
    return F.make_ym_interval(F.lit(0), (value(n) * {"YEAR": 12, "MONTH": 1}[unit.upper()]).cast("int"))


def to_dsinterval(s: Column) -> Column:
    return s.cast("interval day to second")


def to_yminterval(s: Column) -> Column:
    return s.cast("interval year to month")


def from_tz(ts: Column, zone: str | Column) -> Column:
    """A timestamp with a zone of its own: the instant and the zone's name."""
    return F.struct(F.to_utc_timestamp(ts.cast("timestamp"), value(zone)).alias("ts"), value(zone).alias("tz"))


def sys_extract_utc(zoned: Column) -> Column:
    return zoned["ts"]


def utc_now() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
