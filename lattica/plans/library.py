"""More queries over the function library and the windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import compat, dates, jsonx, strings
from lattica.operators import dml, grouping, ordering, setops
from lattica.plans.catalogue import query
from lattica.sources.tables import load


@query("""SELECT event_id, upper(strftime(ts, '%A')) || ', ' || strftime(ts, '%d') AS day_, strftime(ts, '%j') AS doy, CAST((dayofyear(ts) - 1) // 7 + 1 AS VARCHAR) AS ww, CAST((day(ts) - 1) // 7 + 1 AS VARCHAR) AS w,
    lpad(CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS VARCHAR), 5, '0') AS sod, strftime(ts, '%I:%M %p') AS clock FROM events""")
def format_elements(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    short = F.regexp_replace(dates.to_char(ts, "WW"), "^0", "")
    return load(spark, sf_dir, "events").select("event_id", dates.to_char(ts, 'DAY", "DD').alias("day_"), dates.to_char(ts, "DDD").alias("doy"), short.alias("ww"), dates.to_char(ts, "W").alias("w"), dates.to_char(ts, "SSSSS").alias("sod"), dates.to_char(ts, "HH12:MI AM").alias("clock"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(corr(l_quantity, l_tax) OVER w, 6) AS r, round(covar_pop(l_quantity, l_discount) OVER w, 6) AS cp, round(covar_samp(l_quantity, l_discount) OVER w, 6) AS cs, round(var_pop(l_quantity) OVER w, 6) AS vp,
    CASE WHEN count(l_quantity) OVER w = 1 THEN 0 ELSE round(var_samp(l_quantity) OVER w, 6) END AS v, round(stddev_pop(l_quantity) OVER w, 6) AS sp, min(l_tax) OVER w AS low FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def window_statistics(spark, sf_dir):
    w = ordering.over(["l_suppkey"])
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.corr(q, t).over(w), 6).alias("r"), F.round(F.covar_pop(q, d).over(w), 6).alias("cp"), F.round(F.covar_samp(q, d).over(w), 6).alias("cs"), F.round(F.var_pop(q).over(w), 6).alias("vp"),
        F.round(ordering.spread_over(q, w, F.var_samp), 6).alias("v"), F.round(F.stddev_pop(q).over(w), 6).alias("sp"), F.min(t).over(w).alias("low"),
    )


@query("""SELECT c_custkey, first_value(CASE WHEN c_acctbal > 0 THEN c_custkey END IGNORE NULLS) OVER w AS first_rich, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead,
    round(avg(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS before FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def window_frames_beside(spark, sf_dir):
    w = ordering.over(["c_nationkey"], "c_custkey")
    rich = F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.first(rich, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("first_rich"), F.count(F.lit(1)).over(w.rowsBetween(1, 3)).alias("ahead"), F.round(F.avg("c_acctbal").over(w.rowsBetween(-3, -1)), 4).alias("before"))


@query("""SELECT n_nationkey, substr(n_name, 1, 2) || '**' || substr(n_name, 4) AS ins, CASE n_regionkey WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS in_set, split_part(n_name, ' ', 1) AS head, '   ' AS sp, length(n_name) AS vs, instr(substr(n_name, 2), 'A') > 0 AS has_a, bit_length(n_name) / 8 AS lb FROM nation""", vs="INTEGER", lb="INTEGER")
def more_strings(spark, sf_dir):
    n = F.col("n_name")
    return load(spark, sf_dir, "nation").select("n_nationkey", strings.insert(n, 3, 1, "**").alias("ins"), strings.find_in_set(F.col("n_regionkey").cast("string"), F.lit("4,1")).alias("in_set"), strings.substring_index(n, " ", 1).alias("head"), F.repeat(F.lit(" "), 3).alias("sp"), strings.lengthb(n).alias("vs"), (strings.instr(n, "A", 2) > 0).alias("has_a"), F.octet_length(n).alias("lb"))


@query("""SELECT n_nationkey, '[' || n_nationkey || ']' AS with_, NULL AS without_, '[]' AS empty_, true AS is_array, n_nationkey AS val FROM nation""", without_="VARCHAR")
def json_clauses(spark, sf_dir):
    doc = jsonx.json_object("a", F.col("n_nationkey"), "l", F.array(F.col("n_nationkey")))
    return load(spark, sf_dir, "nation").select("n_nationkey", jsonx.json_query(doc, "$.a", "with").alias("with_"), jsonx.json_query(doc, "$.a").alias("without_"), jsonx.json_query(doc, "$.zz", on_error="empty").alias("empty_"), jsonx.json_query(doc, "$.l").startswith("[").alias("is_array"), jsonx.json_value(doc, "$.l[0]", "int").alias("val"))


@query("""SELECT t.c_custkey, round(CASE WHEN o.n IS NOT NULL THEN t.c_acctbal + o.n ELSE t.c_acctbal END, 2) AS c_acctbal FROM customer t LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey WHERE NOT (o.n IS NOT NULL AND t.c_acctbal < 0)""")
def merge_delete(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return dml.merge(c, o, ["c_custkey"], update={"c_acctbal": F.col("t.c_acctbal") + F.col("s.n")}, delete_where=F.col("t.c_acctbal") < 0).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT o_custkey AS k, max(o_orderdate) AS latest, arg_max(o_orderkey, o_orderkey + 1000000000 * epoch(o_orderdate)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_row(spark, sf_dir):
    return dml.latest(load(spark, sf_dir, "orders"), ["o_custkey"], ["-o_orderdate", "-o_orderkey"]).select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("latest"), "o_orderkey")


@query("""SELECT o_orderstatus, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, y), (y)) HAVING sum(o_totalprice) > 1000""", y="INTEGER")
def grouping_expressions(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return grouping.grouping_sets(o, [["o_orderstatus", "y"], ["y"]], F.round(F.sum("o_totalprice"), 2).alias("total"), having=F.col("total") > 1000)


@query("""SELECT sum(CAST(o_orderkey AS HUGEINT))::DOUBLE AS total, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day, round(median(o_totalprice), 4) AS mid, to_timestamp(epoch(median(o_orderdate)))::TIMESTAMP AS mid_day FROM orders""")
def sums_and_medians(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    day = F.timestamp_seconds(F.floor(F.median(F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 1e6))
    return o.agg(compat.sum_number(F.col("o_orderkey")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"), F.min(F.col("o_orderdate").cast("date")).alias("first_day"), F.round(F.median("o_totalprice"), 4).alias("mid"), day.alias("mid_day"))


@query("SELECT k, v FROM (SELECT n_nationkey::DOUBLE AS k, n_name AS v FROM nation UNION ALL SELECT s_acctbal, NULL FROM supplier) WHERE k > 3 ORDER BY k DESC, v LIMIT 12")
def set_then_top_n(spark, sf_dir):
    n, s = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), load(spark, sf_dir, "supplier").select("s_acctbal", F.lit(None))
    return ordering.limit(setops.combine(n, ("union all", s)).filter("k > 3"), 12, 0, ["-k", "v"])


@query("SELECT s_suppkey, n_name, r_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND (r_name = 'EUROPE' OR s_acctbal > 9000)")
def comma_join_or(spark, sf_dir):
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).filter("r_name = 'EUROPE' OR s_acctbal > 9000").select("s_suppkey", "n_name", "r_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join_inequality(spark, sf_dir):
    a, b = load(spark, sf_dir, "nation").alias("a"), load(spark, sf_dir, "nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("""SELECT o_orderkey, round(months, 8) AS months, CAST(d + ((8 - dayofweek(d)) % 7 + CASE WHEN dayofweek(d) = 1 THEN 7 ELSE 0 END)::INT AS TIMESTAMP) + (o_orderdate - d::TIMESTAMP) AS next_monday, date_trunc('quarter', o_orderdate)::TIMESTAMP AS tq
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, (year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1 + CASE WHEN day(o_orderdate) = 1 THEN 0 ELSE (day(o_orderdate) - 1 + epoch(o_orderdate - CAST(o_orderdate AS DATE)::TIMESTAMP) / 86400.0) / 31.0 END AS months FROM orders)""")
def months_and_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("timestamp")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(dates.months_between(d, F.lit("1990-01-01").cast("timestamp")), 8).alias("months"), dates.next_day(d, "MONDAY").alias("next_monday"), dates.trunc(d, "Q").alias("tq"))


@query("""SELECT event_id, ts + INTERVAL 90 MINUTE AS a, ts + INTERVAL 14 MONTH AS b, ts - INTERVAL 3 DAY AS c FROM events""")
def intervals(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    e = load(spark, sf_dir, "events")
    return e.select("event_id", (ts + dates.numtodsinterval(1.5, "HOUR")).alias("a"), (ts + dates.numtoyminterval(F.lit(14), "MONTH")).alias("b"), (ts - dates.to_dsinterval(F.lit("3 00:00:00"))).alias("c"))
