"""Numbers, conversions, hashes and session values of the dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.compat import value


def trunc_number(x: Column, n: int = 0) -> Column:
    """Cut toward zero after n decimals; negative n cuts before the point."""
    scale = F.lit(float(10**n))
    shifted = x.cast("double") * scale
    return F.signum(shifted) * F.floor(F.abs(F.round(shifted, 9))) / scale


def round_number(x: Column, n: int = 0) -> Column:
    """Half away from zero."""
    return F.round(x, n)


def number_text(x: Column, fmt: str | None = None) -> Column:
    """TO_CHAR of a number: without a format its digits, with no zeros at the end of its fraction; else a format of 0, 9, point,
    comma, S, MI, PR and $, without the blanks that stand for leading 9s. Text that stands for a number is one."""
    if fmt is None:
        text = x.cast("string")
        return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), "[.]$", "")).otherwise(text)
    body = fmt.upper()
    after = body.partition(".")[2].rstrip("SMIPR$")
    lead = next((s for s in ("S", "MI") if body.startswith(s)), "")
    tail = next((s for s in ("S", "MI", "PR") if body.endswith(s)), "") if not lead else ""
    n = x.cast(f"decimal(38,{len(after)})")
    # the sign is put on by hand: Spark drops the zero before the point of a fraction that has a sign in front
    text = F.trim(F.to_char(F.abs(n), F.lit(body.removeprefix(lead).removesuffix(tail))))
    if tail == "PR":
        return F.when(n < 0, F.concat(F.lit("<"), text, F.lit(">"))).otherwise(text)
    sign = F.when(n < 0, "-").otherwise("+" if "S" in (lead, tail) else "")
    return F.concat(text, sign) if tail else F.concat(sign, text)


def log(*args: Column) -> Column:
    """Natural for one argument; otherwise the base comes first."""
    return F.ln(args[0]) if len(args) == 1 else F.ln(value(args[1])) / F.ln(value(args[0]))


def inet_aton(s: Column) -> Column:
    """The number of an address of four decimal parts; null for anything else."""
    p = F.split(s, r"\.")
    ok = s.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(p, lambda x: x.try_cast("int") <= 255)
    return F.when(ok, F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x.try_cast("bigint")))


def inet_ntoa(n: Column) -> Column:
    part = [F.shiftright(n.cast("bigint"), s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when((n >= 0) & (n <= 4294967295), F.concat_ws(".", *part))


def bin2hex(x: Column) -> Column:
    return F.hex(x.cast("binary"))


def unhex(x: Column) -> Column:
    return F.unhex(x)


def to_number(s: Column, precision: int = 38, scale: int = 10) -> Column:
    return F.trim(s).cast(f"decimal({precision},{scale})")


def to_number_format(s: Column, fmt: str) -> Column:
    return F.to_number(s, F.lit(fmt))


def array_length(x: Column) -> Column:
    """Zero for a null array."""
    return F.when(x.isNull(), 0).otherwise(F.size(x))


def ct_hash(x: Column, buckets: int = 1024) -> Column:
    """A hash bucket of the value, from zero; the algorithm is Spark's."""
    return F.pmod(F.xxhash64(x), F.lit(buckets))


def sys_guid() -> Column:
    return F.upper(F.replace(F.uuid(), F.lit("-"), F.lit("")))


def sys_context(namespace: str, name: str) -> Column:
    """The values of USERENV that Spark has: the user, the schema and the session's zone."""
    known = {"CURRENT_USER": F.current_user, "SESSION_USER": F.current_user, "CURRENT_SCHEMA": F.current_database, "DB_NAME": F.current_catalog, "SESSION_TIMEZONE": F.current_timezone}
    return known[name.upper()]() if namespace.upper() == "USERENV" and name.upper() in known else F.lit(None).cast("string")


def rand(seed: int | None = None) -> Column:
    return F.rand(seed)
