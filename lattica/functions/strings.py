"""String and regular-expression functions of the dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.compat import value


def substr(s: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """From 1; zero counts as 1 and negative starts from the end. Empty if length is under 1 or the start lies outside."""
    start = value(start)
    begin = F.when(start == 0, 1).when(start < 0, F.char_length(s) + start + 1).otherwise(start)
    inside = (begin >= 1) & (begin <= F.char_length(s))
    if length is None:
        return F.when(s.isNull() | start.isNull(), None).when(inside, F.substring(s, begin, F.char_length(s))).otherwise(F.lit(""))
    length = value(length)
    return F.when(s.isNull() | start.isNull() | length.isNull(), None).when(inside & (length >= 1), F.substring(s, begin, length)).otherwise(F.lit(""))


def substrb(s: Column, start: int, length: int | None = None) -> Column:
    """substr() over the bytes of UTF-8. Both ends have to fall between characters."""
    begin = start if start > 0 else 1 if start == 0 else F.octet_length(s) + start + 1
    part = F.substring(F.encode(s, "UTF-8"), value(begin), F.octet_length(s) if length is None else F.lit(max(0, length)))
    return F.decode(part, "UTF-8")


def instr(s: Column, sub: str | Column, start: int = 1, nth: int = 1) -> Column:
    """The position of the nth occurrence from start on, overlapping ones included; from the end backwards if start is negative. Zero if there is none."""
    sub = value(sub)
    if start == 1 and nth == 1:
        return F.instr(s, sub)
    n = F.char_length(s)
    if start > 0:
        places = F.sequence(F.lit(start), F.greatest(n, F.lit(start)))
    else:
        first = F.greatest(n + 1 + start, F.lit(1))
        places = F.sequence(first, F.lit(1), F.lit(-1))
    hits = F.filter(places, lambda i: F.substring(s, i, F.char_length(sub)) == sub)
    return F.when(s.isNull() | sub.isNull(), None).when(n == 0, 0).otherwise(F.coalesce(F.get(hits, nth - 1), F.lit(0)))


def instrb(s: Column, sub: str, start: int = 1, nth: int = 1) -> Column:
    """instr() over bytes: positions in UTF-8. Written over the hexadecimal form, two digits a byte."""
    raw, want = F.hex(F.encode(s, "UTF-8")), sub.encode().hex().upper()
    n = F.octet_length(s)
    places = F.sequence(F.lit(start), F.greatest(n, F.lit(start))) if start > 0 else F.sequence(F.greatest(n + 1 + start, F.lit(1)), F.lit(1), F.lit(-1))
    hits = F.filter(places, lambda i: F.substring(raw, 2 * i - 1, F.lit(len(want))) == want)
    return F.when(s.isNull(), None).when(n == 0, 0).otherwise(F.coalesce(F.get(hits, nth - 1), F.lit(0)))


def replace(s: Column, search, new="") -> Column:
    """All matches replaced, or deleted if new is left out; an empty or null search gives the source."""
    search = value(search)
    return F.when(search.isNull() | (search == ""), s).otherwise(F.replace(s, search, F.coalesce(value(new), F.lit(""))))


def insert(s: Column, pos: int, length: int, new: str | Column) -> Column:
    """length characters from pos on replaced by new; the source if pos lies outside."""
    n = F.char_length(s)
    rest = F.when(F.lit(length) < 0, F.lit("")).otherwise(substr(s, pos + length)) if length >= 0 else F.lit("")
    return F.when((F.lit(pos) < 1) | (F.lit(pos) > n), s).otherwise(F.concat(F.substring(s, 1, max(0, pos - 1)), value(new), rest))


def trim_set(s: Column, characters: str = " ", side: str = "both") -> Column:
    return {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[side](s, F.lit(characters))


def isnumeric(s: Column) -> Column:
    return F.when(s.isNotNull(), s.cast("string").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$").cast("int"))


def lengthb(s: Column) -> Column:
    return F.octet_length(s)


def asciistr(s: Column) -> Column:
    r"""Characters outside of ASCII as \XXXX, by UTF-16 units."""
    units = F.regexp_extract_all(F.hex(F.encode(s, "UTF-16BE")), F.lit("(.{4})"), 1)
    return F.array_join(F.transform(units, lambda u: F.when(u < "0080", F.decode(F.unhex(F.substring(u, 3, 2)), "US-ASCII")).otherwise(F.concat(F.lit("\\"), u))), "")


#: The printable ASCII characters and their full-width forms lie FULL_WIDTH apart; the space has its own.
ASCII_PRINTABLE = "".join(map(chr, range(33, 127)))
FULL_WIDTH = 0xFEE0


def to_multi_byte(s: Column) -> Column:
    return F.translate(s, " " + ASCII_PRINTABLE, "　" + "".join(chr(ord(c) + FULL_WIDTH) for c in ASCII_PRINTABLE))


def to_single_byte(s: Column) -> Column:
    return F.translate(s, "　" + "".join(chr(ord(c) + FULL_WIDTH) for c in ASCII_PRINTABLE), " " + ASCII_PRINTABLE)


FLAGS = {"c": "-i", "i": "i", "n": "s", "m": "m", "x": "x"}


def pattern(p: str, flags: str = "") -> str:
    """The pattern with its flags inline: i ignores case, n lets the dot match line ends, m is multi-line, x ignores white space."""
    on = "".join(FLAGS[f] for f in flags if f != "c")
    return f"(?{on}){p}" if on else p


def regexp_like(s: Column, p: str, flags: str = "") -> Column:
    return F.rlike(s, F.lit(pattern(p, flags)))


def regexp_count(s: Column, p: str, start: int = 1, flags: str = "") -> Column:
    return F.regexp_count(F.substring(s, F.lit(start), F.char_length(s)), F.lit(pattern(p, flags)))


def regexp_substr(s: Column, p: str, start: int = 1, nth: int = 1, flags: str = "", group: int = 0) -> Column:
    return F.get(F.regexp_extract_all(F.substring(s, F.lit(start), F.char_length(s)), F.lit(pattern(p, flags)), group), F.lit(nth - 1))


def regexp_instr(s: Column, p: str, start: int = 1, nth: int = 1, after: int = 0, flags: str = "") -> Column:
    """The position of the nth match, or behind it if after is 1; zero if there is none. A pattern has to match one character or more."""
    tail = F.substring(s, F.lit(start), F.char_length(s))
    hits, between = F.regexp_extract_all(tail, F.lit(pattern(p, flags)), 0), F.split(tail, pattern(p, flags), -1)

    def length(parts: Column, n: int) -> Column:
        return F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.char_length(x))

    at = length(between, nth) + length(hits, nth if after else nth - 1) + start
    return F.when(s.isNull(), None).when(F.size(hits) < nth, 0).otherwise(at).cast("int")


def regexp_replace(s: Column, p: str, new: str = "", start: int = 1, nth: int = 0, flags: str = "") -> Column:
    """All matches from start on replaced, or only the nth."""
    if start == 1 and nth == 0:
        return F.regexp_replace(s, pattern(p, flags), new)
    head, tail = F.substring(s, 1, start - 1), F.substring(s, F.lit(start), F.char_length(s))
    if nth == 0:
        return F.concat(head, F.regexp_replace(tail, pattern(p, flags), new))
    parts = F.split(tail, pattern(p, flags), -1)
    hits = F.regexp_extract_all(tail, F.lit(pattern(p, flags)), 0)
    put = F.transform(hits, lambda h, i: F.when(i == nth - 1, F.lit(new)).otherwise(h))
    return F.concat(head, F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("t"), put.alias("h")), lambda z: F.array(z["t"], F.coalesce(z["h"], F.lit(""))))), ""))


def substring_index(s: Column, delimiter: str, count: int) -> Column:
    return F.substring_index(s, delimiter, count)


def soundex(s: Column) -> Column:
    return F.soundex(s)


def find_in_set(s, listed: Column) -> Column:
    return F.find_in_set(value(s), listed)
