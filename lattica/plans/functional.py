"""Queries over the function library: numbers, text, dates, conversions, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import compat, dates, jsonx, misc, strings
from lattica.plans.catalogue import query
from lattica.sources.json_table import json_table
from lattica.sources.tables import load


def rounded(**columns):
    return [F.round(c, 8).alias(n) for n, c in columns.items()]


@query("""SELECT s_suppkey, round(abs(-s_acctbal), 8) AS a, round(acos(x), 8) AS ac, round(asin(x), 8) AS asn, round(atan(x), 8) AS at, round(atan2(x, 2), 8) AS at2, round(cos(x), 8) AS c, round(sin(x), 8) AS s, round(tan(x), 8) AS t, round(tanh(x), 8) AS th, round(exp(x), 8) AS e,
    round(ln(s_suppkey), 8) AS l, round(ln(s_suppkey) / ln(2), 8) AS l2, round(power(x, 3), 8) AS p, round(radians(s_suppkey), 8) AS r, round(sqrt(s_suppkey), 8) AS sq, round(pi(), 8) AS pi FROM (SELECT *, s_suppkey / 100000.0 AS x FROM supplier WHERE s_suppkey > 0)""")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x = F.col("s_suppkey"), F.col("s_suppkey") / 100000.0
    return load(spark, sf_dir, "supplier").filter("s_suppkey > 0").select("s_suppkey", *rounded(a=F.abs(-F.col("s_acctbal")), ac=F.acos(x), asn=F.asin(x), at=F.atan(x), at2=F.atan2(x, F.lit(2.0)), c=F.cos(x), s=F.sin(x), t=F.tan(x), th=F.tanh(x), e=F.exp(x), l=misc.log(k), l2=misc.log(F.lit(2), k), p=F.power(x, F.lit(3)), r=F.radians(k), sq=F.sqrt(k), pi=F.pi()))


@query("""SELECT c_custkey, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, sign(c_acctbal) AS sg, round(c_acctbal, 1) AS r1, round(c_acctbal, -2) AS r_2, trunc(c_acctbal) AS t0, round(trunc(c_acctbal * 10) / 10, 8) AS t1, c_custkey % 7 AS m7, c_custkey AS m0,
    greatest(c_acctbal, 10) AS g, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE greatest(c_custkey, 50) END AS gn, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE least(c_custkey, 50) END AS ln FROM customer""", up="BIGINT", down="BIGINT", sg="DOUBLE")
def rounding_and_extremes(spark, sf_dir):
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    some = F.when(k % 5 != 0, k)
    return load(spark, sf_dir, "customer").select(
        "c_custkey", F.ceil(b).alias("up"), F.floor(b).alias("down"), F.signum(b).alias("sg"), misc.round_number(b, 1).alias("r1"), misc.round_number(b, -2).alias("r_2"), misc.trunc_number(b).alias("t0"), F.round(misc.trunc_number(b, 1), 8).alias("t1"),
        compat.mod(k, F.lit(7)).alias("m7"), compat.mod(k, F.lit(0)).alias("m0"), compat.greatest(b, F.lit(10.0)).alias("g"), compat.greatest(some, F.lit(50)).alias("gn"), compat.least(some, F.lit(50)).alias("ln"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '' END || p_brand AS cat, coalesce(s, 0) AS nvl, CASE WHEN s IS NOT NULL THEN 'big' ELSE 'small' END AS nvl2, nullif(p_size, 10) AS nif, CASE WHEN s IS NULL THEN 'none' WHEN s = 30 THEN 'thirty' ELSE 'other' END AS dec, coalesce(s > 30, false) = false AS lnn
    FROM (SELECT *, CASE WHEN p_size > 25 THEN p_size END AS s FROM part)""")
def null_functions(spark, sf_dir):
    s = F.when(F.col("p_size") > 25, F.col("p_size"))
    return load(spark, sf_dir, "part").select(
        "p_partkey", compat.cat(s, F.col("p_brand")).alias("cat"), compat.nvl(s, 0).alias("nvl"), compat.nvl2(s, "big", "small").alias("nvl2"), F.nullif(F.col("p_size"), F.lit(10)).alias("nif"), compat.decode(s, None, "none", 30, "thirty", "other").alias("dec"), compat.lnnvl(s > 30).alias("lnn"),
    )


@query("""SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS lo, length(c_name) AS len, octet_length(encode(c_name)) AS bytes, left(c_name, 4) AS l4, right(c_name, 3) AS r3, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '-') AS rp, repeat('ab', 3) AS rep, reverse(c_mktsegment) AS rev,
    replace(c_name, '#', '') AS rpl, translate(c_mktsegment, 'AEIOU', '12345') AS tr, ascii(c_name) AS asc, chr(65) AS ch, concat_ws('-', c_custkey, c_mktsegment) AS cw, instr(c_name, '#') AS pos, substring(c_name, 3, 5) AS sub, right(c_name, 5) AS subn, trim('x' FROM 'xxabxx') AS tb, ltrim('xxab', 'x') AS tl, rtrim('abxx', 'x') AS rt, md5(c_name) AS md FROM customer""", len="INTEGER", bytes="INTEGER", pos="INTEGER")
def string_functions(spark, sf_dir):
    n, g = F.col("c_name"), F.col("c_mktsegment")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(n).alias("up"), F.lower(n).alias("lo"), F.char_length(n).alias("len"), strings.lengthb(n).alias("bytes"), F.left(n, F.lit(4)).alias("l4"), F.right(n, F.lit(3)).alias("r3"), F.lpad(g, 12, "*").alias("lp"), F.rpad(g, 12, "-").alias("rp"),
        F.repeat(F.lit("ab"), 3).alias("rep"), F.reverse(g).alias("rev"), strings.replace(n, "#").alias("rpl"), F.translate(g, "AEIOU", "12345").alias("tr"), F.ascii(n).alias("asc"), F.char(F.lit(65)).alias("ch"), F.concat_ws("-", F.col("c_custkey").cast("string"), g).alias("cw"),
        strings.instr(n, "#").alias("pos"), strings.substr(n, 3, 5).alias("sub"), strings.substr(n, -5).alias("subn"), strings.trim_set(F.lit("xxabxx"), "x").alias("tb"), strings.trim_set(F.lit("xxab"), "x", "leading").alias("tl"), strings.trim_set(F.lit("abxx"), "x", "trailing").alias("rt"), F.md5(n).alias("md"),
    )


@query("""SELECT conv_id, turn, len(regexp_extract_all(text, '[aeiou]+')) AS vowels, regexp_replace(text, '[0-9]+', '#', 'g') AS masked, regexp_extract(text, '[A-Z][a-z]+') AS word, list_extract(regexp_extract_all(text, '[a-z]+'), 2) AS second, split_part(text, ' ', 1) AS head FROM conversations""", vowels="INTEGER")
def regexp_functions(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", strings.regexp_count(t, "[aeiou]+").alias("vowels"), strings.regexp_replace(t, "[0-9]+", "#").alias("masked"), F.coalesce(strings.regexp_substr(t, "[A-Z][a-z]+"), F.lit("")).alias("word"), strings.regexp_substr(t, "[a-z]+", 1, 2).alias("second"), strings.substring_index(t, " ", 1).alias("head"))


@query("""SELECT doc_id, strpos(text, 'e') AS first_e, CASE WHEN strpos(substr(text, 10), 'e') = 0 THEN 0 ELSE strpos(substr(text, 10), 'e') + 9 END AS from10, octet_length(encode(text)) AS bytes, length(text) AS n FROM documents""", first_e="INTEGER", from10="INTEGER", bytes="INTEGER", n="INTEGER")
def instr_positions(spark, sf_dir):
    t = F.col("text")
    from10 = F.locate("e", t, 10)
    return load(spark, sf_dir, "documents").select("doc_id", strings.instr(t, "e").alias("first_e"), from10.alias("from10"), strings.lengthb(t).alias("bytes"), F.char_length(t).alias("n"))


@query("""SELECT event_id, ts + INTERVAL 36 HOUR AS later, round(epoch_us(ts) / 86400000000.0 - 19000, 8) AS days, date_diff('day', TIMESTAMP '2020-01-01', date_trunc('day', ts)) AS d, strftime(ts, '%Y/%m/%d %H:%M:%S') AS txt, upper(strftime(ts, '%b')) AS mon, quarter(ts)::VARCHAR AS q, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS back FROM events""", d="INTEGER")
def date_arithmetic_formats(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    start = F.lit("1970-01-01").cast("timestamp")
    return load(spark, sf_dir, "events").select(
        "event_id", dates.add_days(ts, 1.5).alias("later"), F.round(dates.days_between(ts, start) - 19000, 8).alias("days"), F.datediff(ts, F.lit("2020-01-01").cast("date")).alias("d"), dates.to_char(ts, "YYYY/MM/DD HH24:MI:SS").alias("txt"),
        dates.to_char(ts, "MON").alias("mon"), dates.to_char(ts, "Q").alias("q"), dates.to_date(dates.to_char(ts)).alias("back"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, date_diff('hour', a, b) AS hours_, date_sub('day', a, b) AS days_, CAST(trunc(date_sub('day', a, b) / 7) AS BIGINT) AS weeks_, date_sub('month', a, b) AS months_, date_sub('year', a, b) AS years_, a + INTERVAL 90 MINUTE AS added
    FROM (SELECT *, date_trunc('day', l_shipdate) AS a, TIMESTAMP '1998-12-01' AS b FROM lineitem)""")
def timestamp_diff_add(spark, sf_dir):
    a, b = F.date_trunc("DAY", F.col("l_shipdate").cast("timestamp")), F.lit("1998-12-01").cast("timestamp")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *(dates.timestampdiff(u, a, b).alias(f"{u.lower()}s_") for u in ("HOUR", "DAY", "WEEK", "MONTH", "YEAR")), dates.timestampadd("MINUTE", 90, a).alias("added"))


@query("""SELECT s_suppkey, hex(s_name) AS hx, CAST(s_suppkey AS VARCHAR) AS txt, CAST(s_acctbal AS DECIMAL(38, 10)) AS num, (s_suppkey % 256) * 16777216 + 10 * 256 + 1 AS ip, (s_suppkey % 256)::VARCHAR || '.0.10.1' AS back, 1 AS isnum, 0 AS notnum FROM supplier""")
def conversion_functions(spark, sf_dir):
    k = F.col("s_suppkey")
    ip = F.concat((k % 256).cast("string"), F.lit(".0.10.1"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.hex("s_name").alias("hx"), k.cast("string").alias("txt"), misc.to_number(F.col("s_acctbal").cast("string")).alias("num"), misc.inet_aton(ip).alias("ip"), misc.inet_ntoa(misc.inet_aton(ip)).alias("back"), strings.isnumeric(k.cast("string")).alias("isnum"), strings.isnumeric(F.col("s_name")).alias("notnum"))


@query("SELECT l_linestatus, count(DISTINCT l_suppkey) AS n, count(*) AS inside, count(*) AS names FROM lineitem GROUP BY l_linestatus")
def hash_and_ids(spark, sf_dir):
    bucket = misc.ct_hash(F.col("l_suppkey"), 16)
    named = load(spark, sf_dir, "lineitem").select("l_linestatus", "l_suppkey", bucket.alias("bucket"), misc.sys_guid().alias("guid"))
    return named.groupBy("l_linestatus").agg(F.count_distinct("l_suppkey").alias("n"), F.count_if(F.col("bucket").between(0, 15)).alias("inside"), F.count_if(F.length("guid") == 32).alias("names"))


@query()
def random_and_session(spark, sf_dir):
    """Values that differ by run or session: rows only."""
    return load(spark, sf_dir, "nation").select("n_nationkey", misc.rand().alias("r"), F.uuid().alias("u"), F.current_timestamp().alias("at"), dates.utc_now().alias("utc"), misc.sys_context("USERENV", "CURRENT_USER").alias("who"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.zz') AS has_zz, json_valid(props) AS ok FROM events""")
def json_value_exists(spark, sf_dir):
    p = F.col("props")
    return load(spark, sf_dir, "events").select("event_id", jsonx.json_value(p, "$.k", "bigint").alias("k"), jsonx.json_exists(p, "$.k").alias("has_k"), jsonx.json_exists(p, "$.zz").alias("has_zz"), jsonx.is_json(p).alias("ok"))


@query("""SELECT n_nationkey, '["' || n_name || '"]' AS arr, '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' AS obj, '{"id":' || n_nationkey || ',"name":"x","r":' || n_regionkey || '}' AS patched, '{"id":-1,"name":"' || n_name || '"}' AS put, 2 AS len, '[1,2]' AS q FROM nation""")
def json_construct_change(spark, sf_dir):
    n, k = F.col("n_name"), F.col("n_nationkey")
    made = jsonx.json_object("id", k, "name", n)
    patch = F.concat(F.lit('{"name":"x","r":'), F.col("n_regionkey").cast("string"), F.lit("}"))
    doc = F.lit('{"a":[1,2]}')
    return load(spark, sf_dir, "nation").select("n_nationkey", jsonx.json_array(n, None).alias("arr"), made.alias("obj"), jsonx.json_mergepatch(made, patch).alias("patched"), jsonx.json_set(made, "$.id", F.lit("-1")).alias("put"), jsonx.json_array_length(F.lit("[1,2]")).alias("len"), jsonx.json_query(doc, "$.a").alias("q"))


@query("""SELECT o_orderkey, CASE WHEN d = last_day(d) THEN last_day(CAST(d + INTERVAL 1 MONTH AS DATE)) ELSE CAST(d + INTERVAL 1 MONTH AS DATE) END::TIMESTAMP + (o_orderdate - d::TIMESTAMP) AS next_month, last_day(d)::TIMESTAMP + (o_orderdate - d::TIMESTAMP) AS month_end,
    year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS dd, hour(o_orderdate) AS h, date_trunc('month', o_orderdate)::TIMESTAMP AS tm, date_trunc('year', o_orderdate)::TIMESTAMP AS ty, CASE WHEN day(d) >= 16 THEN date_trunc('month', o_orderdate + INTERVAL 1 MONTH) ELSE date_trunc('month', o_orderdate) END::TIMESTAMP AS rm
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""", y="INTEGER", q="INTEGER", m="INTEGER", dd="INTEGER", h="INTEGER")
def date_functions(spark, sf_dir):
    d = F.col("o_orderdate").cast("timestamp")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", dates.add_months(d, 1).alias("next_month"), dates.last_day(d).alias("month_end"), F.year(d).alias("y"), F.quarter(d).alias("q"), F.month(d).alias("m"), F.dayofmonth(d).alias("dd"), F.hour(d).alias("h"),
        dates.trunc(d, "MM").alias("tm"), dates.trunc(d, "YYYY").alias("ty"), dates.round_date(d, "MONTH").alias("rm"),
    )


@query("""SELECT o_orderkey, u.i AS pos, o_orderkey * 10 + u.i AS val FROM orders, (SELECT range AS i FROM range(1, 4)) u""", pos="INTEGER")
def json_table_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    doc = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct((k * 10 + i).alias("v"))).alias("items")))
    rows = json_table(load(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc")), "doc", "$.items[*]", {"val": ("bigint", "$.v")}, ordinality="pos")
    return rows.select("o_orderkey", "pos", "val")
