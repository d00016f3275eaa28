"""The dialect's functions for SQL text: temporary SQL functions that Catalyst inlines.

Spark doesn't let its own names be replaced, so a function that it has under another meaning gets the prefix
``d_``: d_substr, d_mod, d_add_months and so on. All others go by their own names.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name and parameters -> result type and body
DEFINITIONS = {
    "bitand(a BIGINT, b BIGINT)": ("BIGINT", "a & b"),
    "bitor(a BIGINT, b BIGINT)": ("BIGINT", "a | b"),
    "bitxor(a BIGINT, b BIGINT)": ("BIGINT", "a ^ b"),
    "lnnvl(c BOOLEAN)": ("BOOLEAN", "NOT coalesce(c, false)"),
    "lengthb(s STRING)": ("INT", "octet_length(s)"),
    "vsize(s STRING)": ("INT", "octet_length(s)"),
    "isnumeric(s STRING)": ("INT", r"CAST(s RLIKE '^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$' AS INT)"),
    "hextoraw(s STRING)": ("BINARY", "unhex(s)"),
    "hex2bin(s STRING)": ("BINARY", "unhex(s)"),
    "rawtohex(x BINARY)": ("STRING", "hex(x)"),
    "bin2hex(x BINARY)": ("STRING", "hex(x)"),
    "inet_ntoa(n BIGINT)": ("STRING", "CASE WHEN n BETWEEN 0 AND 4294967295 THEN concat_ws('.', n DIV 16777216, n DIV 65536 % 256, n DIV 256 % 256, n % 256) END"),
    "inet_aton(s STRING)": ("BIGINT", "CASE WHEN s RLIKE '^[0-9]{1,3}([.][0-9]{1,3}){3}$' AND forall(split(s, '[.]'), x -> try_cast(x AS INT) <= 255) THEN aggregate(split(s, '[.]'), 0L, (a, x) -> a * 256 + try_cast(x AS BIGINT)) END"),
    "array_length(x ARRAY<STRING>)": ("INT", "coalesce(array_size(x), 0)"),
    "to_clob(s STRING)": ("STRING", "s"),
    "empty_clob()": ("STRING", "''"),
    "sys_guid()": ("STRING", "upper(replace(uuid(), '-', ''))"),
    "numtoyminterval(n INT, unit STRING)": ("INTERVAL YEAR TO MONTH", "make_ym_interval(0, n * CASE upper(unit) WHEN 'YEAR' THEN 12 ELSE 1 END)"),
    "numtodsinterval(n DOUBLE, unit STRING)": ("INTERVAL DAY TO SECOND", "make_dt_interval(0, 0, 0, CAST(round(n * CASE upper(unit) WHEN 'DAY' THEN 86400 WHEN 'HOUR' THEN 3600 WHEN 'MINUTE' THEN 60 ELSE 1 END, 6) AS DECIMAL(18, 6)))"),
    "to_dsinterval(s STRING)": ("INTERVAL DAY TO SECOND", "CAST(s AS INTERVAL DAY TO SECOND)"),
    "to_yminterval(s STRING)": ("INTERVAL YEAR TO MONTH", "CAST(s AS INTERVAL YEAR TO MONTH)"),
    "json_value(j STRING, p STRING)": ("STRING", r"CASE WHEN NOT coalesce(get_json_object(j, p) RLIKE '^\\s*[\\[{]', false) THEN get_json_object(j, p) END"),
    "json_query(j STRING, p STRING)": ("STRING", r"CASE WHEN get_json_object(j, p) RLIKE '^\\s*[\\[{]' THEN get_json_object(j, p) END"),
    "json_exists(j STRING, p STRING)": ("BOOLEAN", "get_json_object(j, p) IS NOT NULL"),
    "cat(a STRING, b STRING)": ("STRING", "CASE WHEN coalesce(a, b) IS NOT NULL THEN concat_ws('', a, b) END"),
    "d_concat(a STRING, b STRING)": ("STRING", "CASE WHEN coalesce(a, b) IS NOT NULL THEN concat_ws('', a, b) END"),
    "d_mod(x DOUBLE, y DOUBLE)": ("DOUBLE", "CASE WHEN y = 0 THEN x ELSE try_mod(x, y) END"),
    "d_greatest(a DOUBLE, b DOUBLE)": ("DOUBLE", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END"),
    "d_least(a DOUBLE, b DOUBLE)": ("DOUBLE", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END"),
    "d_substr(s STRING, b INT, n INT DEFAULT 2147483647)": ("STRING", "CASE WHEN s IS NULL OR b IS NULL OR n IS NULL THEN NULL WHEN n < 1 OR abs(b) > char_length(s) THEN '' ELSE substr(s, CASE WHEN b = 0 THEN 1 ELSE b END, n) END"),
    "d_replace(s STRING, a STRING, b STRING DEFAULT '')": ("STRING", "CASE WHEN coalesce(a, '') = '' THEN s ELSE replace(s, a, coalesce(b, '')) END"),
    "d_add_months(d TIMESTAMP, n INT)": ("TIMESTAMP", "CAST(CASE WHEN CAST(d AS DATE) = last_day(d) THEN last_day(add_months(d, n)) ELSE add_months(d, n) END AS TIMESTAMP) + (d - date_trunc('DAY', d))"),
    "d_last_day(d TIMESTAMP)": ("TIMESTAMP", "CAST(last_day(d) AS TIMESTAMP) + (d - date_trunc('DAY', d))"),
    "d_next_day(d TIMESTAMP, w STRING)": ("TIMESTAMP", "CAST(next_day(d, w) AS TIMESTAMP) + (d - date_trunc('DAY', d))"),
    "d_months_between(a TIMESTAMP, b TIMESTAMP)": ("DOUBLE", "months_between(a, b, false)"),
    "days_between(a TIMESTAMP, b TIMESTAMP)": ("DOUBLE", "(unix_micros(a) - unix_micros(b)) / 86400000000D"),
    "d_trunc(x DOUBLE, n INT DEFAULT 0)": ("DOUBLE", "sign(x) * floor(abs(round(x * power(10D, n), 9))) / power(10D, n)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; gives their names. Also lets set operators bind equally, left to right, as the dialect does."""
    for head, (result, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
    spark.conf.set("spark.sql.legacy.setopsPrecedence.enabled", "true")
    return [head.split("(")[0] for head in DEFINITIONS]
