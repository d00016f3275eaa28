"""Queries over the functions by their dialect names: bytes, zones, session values, number texts, several keys."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import compat, registry
from lattica.functions.registry import dialect
from lattica.operators import dml, frames, joins, ordering
from lattica.plans.catalogue import query
from lattica.sources.json_table import json_table
from lattica.sources.tables import load

WIDE_CAPITALS = "".join(chr(0xFF21 + i) for i in range(26))
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"""SELECT c_custkey, octet_length(encode(left(v, strpos(v, '#') - 1))) + 1 AS at_byte, left(c_name, 3) AS bytes6, '\\00E4\\20AC' || c_name AS ascii_text, translate(c_mktsegment, '{CAPITALS}', '{WIDE_CAPITALS}') AS wide, c_mktsegment AS narrow,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A351' WHEN 'BUILDING' THEN 'B435' WHEN 'FURNITURE' THEN 'F653' WHEN 'MACHINERY' THEN 'M256' WHEN 'HOUSEHOLD' THEN 'H243' END AS sound FROM (SELECT *, 'ä€' || c_name AS v FROM customer)""", at_byte="INTEGER")
def byte_and_width_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, g = F.concat(F.lit("ä€"), F.col("c_name")), F.col("c_mktsegment")
    wide = dialect("to_multi_byte")(g)
    return load(spark, sf_dir, "customer").select(
        "c_custkey", dialect("instrb")(v, "#").alias("at_byte"), dialect("substrb")(v, 6, 3).alias("bytes6"), dialect("asciistr")(v).alias("ascii_text"), wide.alias("wide"), dialect("to_single_byte")(wide).alias("narrow"), dialect("soundex")(g).alias("sound"),
    )


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]') THEN length(regexp_extract(text, '^([^0-9]*)[0-9]', 1)) + 1 ELSE 0 END AS first_at,
    CASE WHEN regexp_matches(text, '^[^0-9]*[0-9]+[^0-9]+[0-9]') THEN length(regexp_extract(text, '^([^0-9]*[0-9]+[^0-9]+)[0-9]', 1)) + 1 ELSE 0 END AS second_at,
    CASE WHEN regexp_matches(text, '[0-9]') THEN length(regexp_extract(text, '^([^0-9]*[0-9]+)', 1)) + 1 ELSE 0 END AS behind FROM conversations""", first_at="INTEGER", second_at="INTEGER", behind="INTEGER")
def regexp_positions(spark, sf_dir):
    t, at = F.col("text"), dialect("regexp_instr")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", at(t, "[0-9]+").alias("first_at"), at(t, "[0-9]+", 1, 2).alias("second_at"), at(t, "[0-9]+", 1, 1, 1).alias("behind"))


@query("""SELECT event_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS txt, ts - INTERVAL 2 HOUR AS utc, ts AS back, ts + to_months(CAST(12 * (event_id % 3) + event_id % 12 AS INTEGER)) AS later FROM events""")
def unix_times_and_zones(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    seconds = dialect("unix_timestamp")(ts)
    text = dialect("to_char")(F.col("ts"), "YYYY-MM-DD HH24:MI:SS.FF")
    months = F.concat_ws("-", (F.col("event_id") % 3).cast("string"), (F.col("event_id") % 12).cast("string"))
    return load(spark, sf_dir, "events").select(
        "event_id", seconds.alias("seconds"), dialect("from_unixtime")(seconds, "%Y-%m-%d %H:%i:%s").alias("txt"), dialect("sys_extract_utc")(dialect("from_tz")(ts, "+02:00")).alias("utc"), dialect("to_timestamp")(text).alias("back"), (ts + dialect("to_yminterval")(months)).alias("later"),
    )


@query("""SELECT n_nationkey, hex(n_name) AS hx, n_name AS a, n_name AS b, n_name AS c, hex(n_name) AS d, CAST(n_nationkey AS VARCHAR) AS e, CAST(n_nationkey AS VARCHAR) AS f, sha1(n_name) AS g, sha1(n_name) AS h FROM nation""")
def bytes_and_texts(spark, sf_dir):
    n, k = F.col("n_name"), F.col("n_nationkey")
    hx = dialect("bin2hex")(n)
    made = {"a": dialect("hex2bin")(hx).cast("string"), "b": dialect("hextoraw")(hx).cast("string"), "c": dialect("unhex")(hx).cast("string"), "d": dialect("rawtohex")(dialect("to_blob")(n)), "e": dialect("to_clob")(k), "f": dialect("convert")(k, "string"), "g": dialect("sha")(n), "h": dialect("sha1")(n)}
    return load(spark, sf_dir, "nation").select("n_nationkey", hx.alias("hx"), *(c.alias(name) for name, c in made.items()))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN len(string_split(text, ' ')) ELSE 0 END AS n FROM conversations""", n="INTEGER")
def array_lengths(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", dialect("array_length")(F.when(F.col("turn") % 2 == 0, F.split("text", " "))).alias("n"))


@query("""SELECT l_returnflag, count(*) AS randoms, count(*) AS uuids, count(DISTINCT l_partkey) AS hashes FROM lineitem GROUP BY l_returnflag""")
def random_and_hashed_values(spark, sf_dir):
    """As many values between 0 and 1, as many different ids and as many different hashes as there should be."""
    r = dialect("rand")()
    named = load(spark, sf_dir, "lineitem").select("l_returnflag", r.alias("r"), dialect("uuid")().alias("u"), dialect("hash")(F.col("l_partkey")).alias("h"))
    return named.groupBy("l_returnflag").agg(F.count_if((F.col("r") >= 0) & (F.col("r") < 1)).alias("randoms"), F.approx_count_distinct("u", 0.01).alias("_near"), F.count_distinct("u").alias("uuids"), F.count_distinct("h").alias("hashes")).drop("_near")


NOW = ("current_timestamp", "now", "systimestamp", "localtimestamp")
UTC = ("getutcdate", "utc_date", "utc_timestamp")


@query(f"""SELECT n_nationkey, {', '.join(f"CAST(now() AT TIME ZONE 'UTC' AS DATE) AS {n}_day" for n in (*NOW, *UTC))} FROM nation""")
def current_times(spark, sf_dir):
    """Today's date in UTC by each of the clock functions."""
    zone = F.current_timezone()
    local = [F.to_utc_timestamp(dialect(n)().cast("timestamp"), zone).cast("date").alias(f"{n}_day") for n in NOW]
    return load(spark, sf_dir, "nation").select("n_nationkey", *local, *(dialect(n)().cast("date").alias(f"{n}_day") for n in UTC))


@query("""SELECT n_regionkey, count(*) AS named, count(*) AS alike FROM nation GROUP BY n_regionkey""")
def session_values(spark, sf_dir):
    names = ("CURRENT_USER", "SESSION_USER", "CURRENT_SCHEMA", "SESSION_TIMEZONE")
    some, same = F.lit(True), F.lit(True)
    for n in names:
        some = some & (F.length(dialect("sys_context")("USERENV", n)) > 0)
        same = same & (dialect("userenv")(n) == dialect("sys_context")("USERENV", n))
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count_if(some).alias("named"), F.count_if(same).alias("alike"))


@query("""SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS found FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderkey LIMIT 10""")
def found_rows_of_a_page(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    return ordering.with_found_rows(rows, ordering.limit(rows, 10, by=["o_orderkey"])).select("o_orderkey", F.col("found_rows").alias("found"))


@query("""SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS whole, regexp_replace(regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR), '0+$', ''), '\\.$', '') AS plain, printf('%.2f', c_acctbal) AS fixed, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS padded,
    CAST(c_acctbal AS DECIMAL(18, 2)) + 1.5 AS added, c_acctbal > 4000.5 AS more FROM customer""", added="DECIMAL(38, 10)")
def number_texts_and_casts(spark, sf_dir):
    """A key of over nine digits or below zero doesn't fit a format of nine: LPAD pads or cuts its text, as in the SQL.
    Cents are rounded from the number itself and not from its shortest text."""
    k, x = F.col("c_custkey"), F.col("c_acctbal")
    b = (F.round(x * 100).cast("decimal(18, 0)") * F.lit(Decimal("0.01"))).cast("decimal(18, 2)")
    cents = F.expr("format_number(c_acctbal, '0.00')").cast("decimal(18, 2)")
    padded = F.when(k.between(0, 999999999), dialect("to_nchar")(k, "000000000")).otherwise(F.lpad(dialect("to_nchar")(k), 9, "0"))
    return load(spark, sf_dir, "customer").select(
        "c_custkey", dialect("to_char")(k).alias("whole"), dialect("to_char")(b).alias("plain"), dialect("to_char")(cents, "9" * 15 + "0.00").alias("fixed"), padded.alias("padded"),
        compat.arithmetic("+", b, F.lit("1.5")).cast("decimal(38, 10)").alias("added"), compat.compare(">", x.cast("string"), F.lit(4000.5)).alias("more"),
    )


@query("""SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day_, date_trunc('month', o_orderdate)::TIMESTAMP AS month_, CASE WHEN hour(o_orderdate) >= 12 THEN date_trunc('day', o_orderdate) + INTERVAL 1 DAY ELSE date_trunc('day', o_orderdate) END::TIMESTAMP AS near_, trunc(o_totalprice) AS price, round(o_totalprice) AS near_price FROM orders""")
def round_and_trunc_by_type(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    cut, near, d, p = dialect("trunc", o), dialect("round", o), F.col("o_orderdate"), F.col("o_totalprice")
    return o.select("o_orderkey", cut(d).alias("day_"), dialect("trunc")(d, "MM").alias("month_"), near(d).alias("near_"), cut(p).alias("price"), near(p).alias("near_price"))


@query("""SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_nationkey % 3 DESC, n_name) AS names, string_agg(CASE WHEN n_nationkey % 2 = 0 THEN '' END, '' ORDER BY n_name) AS empties, array_agg(n_name ORDER BY n_name DESC) AS listed FROM nation GROUP BY n_regionkey""")
def listagg_by_several_keys(spark, sf_dir):
    n, k = F.col("n_name"), F.col("n_nationkey")
    listagg = dialect("listagg")
    last = F.reverse(F.array_sort(dialect("array_agg")(n)))
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(listagg(n, ";", [(k % 3, True), n]).alias("names"), listagg(F.when(k % 2 == 0, F.lit("")), "", n).alias("empties"), last.alias("listed"))


@query("""SELECT c_nationkey, 1 + count(*) FILTER (c_mktsegment < 'FURNITURE' OR c_mktsegment = 'FURNITURE' AND c_acctbal > 5000) AS place,
    1 + count(DISTINCT CASE WHEN c_mktsegment < 'FURNITURE' OR c_mktsegment = 'FURNITURE' AND c_acctbal > 5000 THEN c_mktsegment || '/' || c_acctbal END) AS dense,
    (1 + count(*) FILTER (c_mktsegment < 'FURNITURE' OR c_mktsegment = 'FURNITURE' AND c_acctbal >= 5000)) / (1.0 + count(*)) AS share FROM customer GROUP BY c_nationkey""", share="DOUBLE")
def hypothetical_by_several_keys(spark, sf_dir):
    values, by = ["FURNITURE", 5000.0], ["c_mktsegment", "-c_acctbal"]
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(dialect("rank")(values, by).alias("place"), dialect("dense_rank")(values, by).alias("dense"), dialect("cume_dist")(values, by).alias("share"))


@query("""SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE (c.c_nationkey = s.s_nationkey OR c.c_custkey % 7 = 0) AND (CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE c.c_custkey END = s.s_suppkey % 50 OR c.c_custkey % 5 = 0 OR s.s_suppkey % 11 = 0) AND c.c_custkey % 3 = 1)""")
def not_in_several_keys(spark, sf_dir):
    k = F.col("c_custkey")
    some = load(spark, sf_dir, "customer").filter(k % 3 == 1).select(F.when(k % 7 != 0, F.col("c_nationkey")).alias("a"), F.when(k % 5 != 0, k).alias("b"))
    s = load(spark, sf_dir, "supplier").withColumns({"a": F.col("s_nationkey"), "b": F.when(F.col("s_suppkey") % 11 != 0, F.col("s_suppkey") % 50)})
    return joins.not_in(s, some, ["a", "b"]).select("s_suppkey")


FRAME = """FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem)"""


@query(f"""WITH b AS (SELECT * {FRAME}) SELECT x.l_orderkey, x.l_linenumber, x.l_suppkey, round(sum(y.q), 6) AS total, count(y.q) AS n, round(avg(y.q), 6) AS mean, min(y.q) AS least, max(y.q) AS most
    FROM b x LEFT JOIN b y ON y.l_suppkey = x.l_suppkey AND y.rn BETWEEN x.rn - x.l_linenumber AND x.rn + x.l_orderkey % 4 GROUP BY x.l_orderkey, x.l_linenumber, x.l_suppkey, x.rn""")
def window_variable_frames(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")))
    wanted = {"total": ("sum", "q"), "n": ("count", "q"), "mean": ("avg", "q"), "least": ("min", "q"), "most": ("max", "q")}
    out = frames.moving(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], F.col("l_linenumber"), F.col("l_orderkey") % 4, wanted)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", F.round("total", 6).alias("total"), "n", F.round("mean", 6).alias("mean"), "least", "most")


@query("""SELECT x.c_custkey, count(*) AS n, max(y.c_acctbal) AS most FROM customer x JOIN customer y ON y.c_nationkey = x.c_nationkey AND y.c_acctbal BETWEEN x.c_acctbal - x.c_custkey % 1000 AND x.c_acctbal + 10 * (x.c_custkey % 7) GROUP BY x.c_custkey""")
def window_variable_ranges(spark, sf_dir):
    k = F.col("c_custkey")
    out = frames.moving(load(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", k % 1000, 10 * (k % 7), {"n": ("count", "c_acctbal"), "most": ("max", "c_acctbal")}, frame="range")
    return out.select("c_custkey", "n", "most")


@query("""SELECT o_orderkey, o_totalprice, low, high FROM orders JOIN (SELECT c_custkey * 100.0 AS low, c_custkey * 100.0 + CASE WHEN c_custkey % 50 = 0 THEN 100000 ELSE 7 END AS high FROM customer) r ON o_totalprice >= low AND o_totalprice < high""")
def range_join_of_uneven_widths(spark, sf_dir):
    k = F.col("c_custkey")
    ranges = load(spark, sf_dir, "customer").select((k * 100.0).alias("low"), (k * 100.0 + F.when(k % 50 == 0, 100000).otherwise(7)).alias("high"))
    return joins.range_join(load(spark, sf_dir, "orders"), ranges, "o_totalprice", "low", "high", 10.0).select("o_orderkey", "o_totalprice", "low", "high")


@query("""SELECT count(*) AS n, min(rownum) AS first, max(rownum) AS last, count(DISTINCT rownum) AS different FROM (SELECT row_number() OVER () AS rownum FROM orders)""")
def rownum_without_order(spark, sf_dir):
    numbered = ordering.with_rownum(load(spark, sf_dir, "orders").select("o_orderkey"))
    return numbered.agg(F.count(F.lit(1)).alias("n"), F.min("rownum").alias("first"), F.max("rownum").alias("last"), F.count_distinct("rownum").alias("different"))


@query("""SELECT s_suppkey, s_name, CASE WHEN s_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 3) THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier""", s_acctbal="DOUBLE")
def update_order_limit(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    return dml.update_first(s, {"s_acctbal": F.lit(0.0)}, F.lit(True), ["s_acctbal", "s_suppkey"], 3, ["s_suppkey"]).select("s_suppkey", "s_name", "s_acctbal")


@query("""SELECT n_nationkey, upper(n_name) AS big, coalesce(nullif(n_name, 'CHINA'), '-') AS some FROM nation""")
def aliased_functions(spark, sf_dir):
    with registry.aliases({"shout": "upper", "or_else": "nvl"}):
        shout, or_else = dialect("shout"), dialect("or_else")
    return load(spark, sf_dir, "nation").select("n_nationkey", shout(F.col("n_name")).alias("big"), or_else(F.nullif(F.col("n_name"), F.lit("CHINA")), "-").alias("some"))


@query("""SELECT o_orderkey, u.i AS pos, o_orderkey + u.i AS val, v.j AS tag_pos, 't' || v.j AS tag FROM orders, (SELECT range AS i FROM range(1, 3)) u, (SELECT range AS j FROM range(1, 3)) v""", pos="INTEGER", tag_pos="INTEGER")
def json_table_nested(spark, sf_dir):
    k = F.col("o_orderkey")
    item = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.struct((k + i).alias("v"), F.array(F.lit("t1"), F.lit("t2")).alias("tags")))
    docs = load(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(item.alias("items"))).alias("doc"))
    rows = json_table(docs, "doc", "$.items[*]", {"val": ("bigint", "$.v"), "tags": ("query", "$.tags")}, ordinality="pos")
    return json_table(rows, "tags", "$[*]", {"tag": ("string", "$")}, ordinality="tag_pos").select("o_orderkey", "pos", "val", "tag_pos", "tag")
