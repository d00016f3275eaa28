"""Queries over relational operators: predicates, joins, grouping, windows, order, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import compat
from lattica.operators import grouping, joins, ordering, setops
from lattica.plans.catalogue import query
from lattica.sources.scratch import materialised
from lattica.sources.tables import load


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING sum(l_quantity) > 100""")
def having_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = load(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    grouped = kept.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))
    return ordering.order_by(grouped.filter("sum_qty > 100"), "l_returnflag", "l_linestatus")


@query("SELECT count(*) AS n, count(c_acctbal) AS n_bal, round(sum(c_acctbal), 2) AS total, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer HAVING count(*) > 0")
def scalar_aggregate(spark, sf_dir):
    c = F.col("c_acctbal")
    return load(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"), F.count(c).alias("n_bal"), F.round(F.sum(c), 2).alias("total"), F.min(c).alias("low"), F.max(c).alias("high")).filter("n > 0")


@query("""SELECT p_partkey, p_name, CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 15 THEN 'medium' ELSE 'small' END AS size_class, CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END AS is_11
    FROM part WHERE (p_size BETWEEN 10 AND 40 AND p_name LIKE '%a%') OR p_type IN ('ECONOMY', 'PROMO') OR NOT (p_retailprice < 1500)""")
def projection_filter_case(spark, sf_dir):
    size = F.col("p_size")
    kept = load(spark, sf_dir, "part").filter((size.between(10, 40) & F.col("p_name").like("%a%")) | F.col("p_type").isin("ECONOMY", "PROMO") | ~(F.col("p_retailprice") < 1500))
    return kept.select("p_partkey", "p_name", F.when(size > 30, "large").when(size > 15, "medium").otherwise("small").alias("size_class"), F.when(F.col("p_brand") == "Brand#11", 1).otherwise(0).alias("is_11"))


@query("""SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[0-9]*[13]$') AND c_mktsegment IS NOT NULL AND c_name LIKE 'Customer#%' ESCAPE '!'""")
def regexp_predicates(spark, sf_dir):
    from lattica.functions.strings import regexp_like

    c = load(spark, sf_dir, "customer")
    return c.filter(regexp_like(F.col("c_name"), "[0-9]*[13]$") & F.col("c_mktsegment").isNotNull() & F.like(F.col("c_name"), F.lit("Customer#%"), F.lit("!"))).select("c_custkey", "c_name")


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_nationkey = s_nationkey GROUP BY n_name""")
def inner_join_star(spark, sf_dir):
    t = {n: load(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    local = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"].filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = t["lineitem"].join(local, F.col("l_suppkey") == F.col("s_suppkey")).join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return out.groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def left_outer_join(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    return joins.plus_join(c, o.filter("o_orderpriority = '1-URGENT'"), c.c_custkey == o.o_custkey).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def right_outer_join(spark, sf_dir):
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


@query("""SELECT c.c_nationkey AS cust_nation, s.s_nationkey AS supp_nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) c
    FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c.c_nationkey = s.s_nationkey""")
def full_outer_join(spark, sf_dir):
    c = load(spark, sf_dir, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("cust_nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("supp_nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, F.col("cust_nation") == F.col("supp_nation"), "full")


@query("SELECT r.r_name AS r_name, n.n_name AS n_name FROM region r CROSS JOIN nation n WHERE n.n_regionkey <> r.r_regionkey")
def cross_theta_join(spark, sf_dir):
    r, n = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    return r.join(n, n.n_regionkey != r.r_regionkey).select("r_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def exists_semi_join(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").filter("o_totalprice > 250000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists_anti_join(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def not_in_null_aware(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").filter("o_totalprice > 100000")
    return joins.not_in(c, o, ["c_custkey"], ["o_custkey"]).select("c_custkey")


@query("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey END FROM orders)")
def not_in_with_null(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 != 0, F.col("o_custkey")).alias("k"))
    return joins.not_in(load(spark, sf_dir, "customer"), o, ["c_custkey"], ["k"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def in_tuple_subquery(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    many = li.groupBy("l_partkey", "l_suppkey").count().filter("count > 1")
    return li.join(many, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size < 3)")
def compare_all(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return joins.any_all(p, p.p_retailprice, ">", "all", p.filter("p_size < 3").select(F.col("p_retailprice").alias("v")), "v").select("p_partkey", "p_retailprice")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal <= ANY (SELECT c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING')")
def compare_any(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    return joins.any_all(s, s.s_acctbal, "<=", "any", load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'"), "c_acctbal").select("s_suppkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey = ANY (SELECT s_nationkey FROM supplier)")
def equal_any(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    return joins.any_all(n, n.n_nationkey, "=", "any", load(spark, sf_dir, "supplier"), "s_nationkey").select("n_nationkey")


@query("SELECT o_orderkey, o_totalprice, (SELECT round(avg(l_quantity), 6) FROM lineitem WHERE l_orderkey = o_orderkey) AS avg_qty FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(spark, sf_dir):
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    mean = F.broadcast(o.agg(F.avg("o_totalprice").alias("mean")))
    kept = o.join(mean, o.o_totalprice > F.col("mean"))
    return joins.lookup_aggregate(kept, li.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], avg_qty=F.round(F.avg("l_quantity"), 6)).select("o_orderkey", "o_totalprice", "avg_qty")


@query("""SELECT s_suppkey, e.lo, count(*) AS n FROM supplier JOIN (SELECT range * 1000.0 - 1000 AS lo, range * 1000.0 AS hi FROM range(0, 12)) e ON s_acctbal >= e.lo AND s_acctbal < e.hi GROUP BY 1, 2""", lo="DOUBLE")
def range_join(spark, sf_dir):
    bands = spark.range(12).select((F.col("id") * 1000.0 - 1000).alias("lo"), (F.col("id") * 1000.0).alias("hi"))
    return joins.range_join(load(spark, sf_dir, "supplier"), bands, "s_acctbal", "lo", "hi", 1000).groupBy("s_suppkey", "lo").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, sum(DISTINCT c_nationkey) AS total, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS vp, round(median(c_acctbal), 4) AS med,
    round(corr(c_acctbal, c_custkey), 8) AS r, round(covar_pop(c_acctbal, c_custkey), 3) AS cp, round(covar_samp(c_acctbal, c_custkey), 3) AS cs FROM customer GROUP BY c_mktsegment""", total="BIGINT")
def statistics_aggregates(spark, sf_dir):
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count_distinct("c_nationkey").alias("nations"), F.sum_distinct("c_nationkey").alias("total"), F.round(compat.stddev(b), 4).alias("sd"), F.round(F.var_pop(b), 2).alias("vp"), F.round(F.median(b), 4).alias("med"),
        F.round(F.corr(b, k), 8).alias("r"), F.round(F.covar_pop(b, k), 3).alias("cp"), F.round(F.covar_samp(b, k), 3).alias("cs"),
    )


@query("""SELECT n_nationkey, CASE WHEN count(s_acctbal) = 1 THEN 0 ELSE round(stddev_samp(s_acctbal), 4) END AS sd, CASE WHEN count(s_acctbal) = 1 THEN 0 ELSE round(var_samp(s_acctbal), 2) END AS v, round(stddev_samp(s_acctbal), 4) AS samp
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def spread_of_single_rows(spark, sf_dir):
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    b = F.col("s_acctbal")
    return n.join(s, s.s_nationkey == n.n_nationkey, "left").groupBy("n_nationkey").agg(F.round(compat.stddev(b), 4).alias("sd"), F.round(compat.variance(b), 2).alias("v"), F.round(F.stddev_samp(b), 4).alias("samp"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_name, '' ORDER BY n_nationkey) AS by_key, list_sort(list(n_nationkey)) AS keys FROM nation GROUP BY n_regionkey")
def listagg_group_concat(spark, sf_dir):
    name = F.col("n_name")
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(compat.group_concat(name).alias("names"), compat.group_concat(name, "", F.col("n_nationkey")).alias("by_key"), F.sort_array(F.collect_list("n_nationkey")).alias("keys"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS about FROM lineitem GROUP BY l_returnflag")
def approx_distinct(spark, sf_dir):
    """The exact count where the sketch is within 8 % of it, and else the sketch's."""
    a, e = F.approx_count_distinct("l_partkey", 0.02), F.count_distinct("l_partkey")
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(a.alias("a"), e.alias("e")).select("l_returnflag", F.when(F.abs(F.col("a") - F.col("e")) <= 0.08 * F.col("e"), F.col("e")).otherwise(F.col("a")).alias("about"))


@query("""SELECT c_mktsegment, 1 + sum(CASE WHEN c_acctbal < 5000 THEN 1 ELSE 0 END) AS rank_5000, 1 + count(DISTINCT CASE WHEN c_nationkey < 10 THEN c_nationkey END) AS dense_10,
    round((sum(CASE WHEN c_acctbal <= 5000 THEN 1 ELSE 0 END) + 1) / (count(*) + 1), 8) AS cume FROM customer GROUP BY c_mktsegment""", rank_5000="BIGINT")
def hypothetical_set(spark, sf_dir):
    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(compat.rank_of(5000, F.col("c_acctbal")).alias("rank_5000"), compat.dense_rank_of(10, F.col("c_nationkey")).alias("dense_10"), F.round(compat.cume_dist_of(5000, F.col("c_acctbal")), 8).alias("cume"))


@query("""SELECT c_mktsegment, c_nationkey, count(*) AS n, grouping(c_mktsegment) AS g_seg, grouping(c_mktsegment) * 2 + grouping(c_nationkey) AS gid FROM customer
    GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ()) HAVING count(*) > 1""", g_seg="INTEGER", gid="INTEGER")
def grouping_sets(spark, sf_dir):
    return grouping.grouping_sets(load(spark, sf_dir, "customer"), [["c_mktsegment", "c_nationkey"], ["c_mktsegment"], []], F.count(F.lit(1)).alias("n"), F.grouping("c_mktsegment").cast("int").alias("g_seg"), F.grouping_id("c_mktsegment", "c_nationkey").cast("int").alias("gid"), having=F.col("n") > 1)


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf_dir):
    return load(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, sf_dir):
    return load(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY c_mktsegment, ROLLUP (c_nationkey)")
def mixed_grouping(spark, sf_dir):
    sets = grouping.combined_sets([["c_mktsegment"]], grouping.rollup_sets(["c_nationkey"]))
    return grouping.grouping_sets(load(spark, sf_dir, "customer"), sets, F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent_n, round(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 2) AS urgent_total,
    count(*) FILTER (o_orderpriority = '5-LOW') AS low_n, round(sum(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 2) AS low_total FROM orders GROUP BY o_orderstatus""")
def pivot(spark, sf_dir):
    out = grouping.pivot(load(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority", {"1-URGENT": "urgent", "5-LOW": "low"}, n=F.count(F.lit(1)), total=F.round(F.sum("o_totalprice"), 2))
    return out.fillna(0, ["urgent_n", "low_n"])


@query("SELECT p_partkey, 'size' AS attr, CAST(p_size AS DOUBLE) AS val FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_retailprice IS NOT NULL")
def unpivot(spark, sf_dir):
    return grouping.unpivot(load(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_partkey"], {"p_size": "size", "p_retailprice": "price"}, "attr", "val")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(3) OVER w AS tile, round(cume_dist() OVER w, 8) AS cd
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC NULLS FIRST, l_linenumber, l_extendedprice, l_partkey)""", rn="INTEGER", rk="INTEGER", dr="INTEGER", tile="INTEGER")
def window_ranking(spark, sf_dir):
    w = ordering.over(["l_orderkey"], "-l_quantity", "l_linenumber", "l_extendedprice", "l_partkey")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(3).over(w).alias("tile"), F.round(F.cume_dist().over(w), 8).alias("cd"))


@query("""SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, -1) OVER w AS next2, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key,
    round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS mean
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_offsets_frames(spark, sf_dir):
    w = ordering.over(["o_custkey"], "o_orderdate", "o_orderkey")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.lag(price).over(w).alias("prev"), F.lead(price, 2, -1.0).over(w).alias("next2"), F.first(key).over(w).alias("first_key"), F.last(key).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("last_key"),
        F.round(F.sum(price).over(w.rowsBetween(-2, 0)), 2).alias("last3"), F.round(F.avg(price).over(ordering.over(["o_custkey"])), 4).alias("mean"),
    )


@query("""SELECT s_suppkey, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 2) AS near, count(*) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM supplier""")
def window_range_frames(spark, sf_dir):
    w = ordering.over(["s_nationkey"], "s_suppkey")
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.sum("s_acctbal").over(w.rangeBetween(-5, 5)), 2).alias("near"), F.count(F.lit(1)).over(w.rangeBetween(W.unboundedPreceding, 0)).alias("upto"))


@query("""SELECT c_custkey, count(DISTINCT c_mktsegment) OVER (PARTITION BY c_nationkey) AS segments, CASE WHEN count(c_acctbal) OVER (PARTITION BY c_nationkey) = 1 THEN 0 ELSE round(stddev_samp(c_acctbal) OVER (PARTITION BY c_nationkey), 4) END AS sd,
    max(c_acctbal) OVER (PARTITION BY c_nationkey) AS high FROM customer""", segments="INTEGER")
def window_distinct_and_spread(spark, sf_dir):
    w = ordering.over(["c_nationkey"])
    return load(spark, sf_dir, "customer").select("c_custkey", ordering.count_distinct_over(F.col("c_mktsegment"), w).alias("segments"), F.round(ordering.spread_over(F.col("c_acctbal"), w), 4).alias("sd"), F.max("c_acctbal").over(w).alias("high"))


@query("SELECT n_nationkey, string_agg(n_name, '|' ORDER BY n_name) OVER (PARTITION BY n_regionkey) AS names, last_value(CASE WHEN n_nationkey % 2 = 0 THEN n_name END IGNORE NULLS) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS last_even FROM nation")
def window_listagg(spark, sf_dir):
    even = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    return load(spark, sf_dir, "nation").select("n_nationkey", ordering.listagg_over(F.col("n_name"), ["n_regionkey"], "|").alias("names"), F.last(even, ignorenulls=True).over(ordering.over(["n_regionkey"], "n_nationkey")).alias("last_even"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN o_orderkey % 2 PRECEDING AND 1 FOLLOWING), 2) AS moved FROM orders")
def window_variable_frame(spark, sf_dir):
    out = ordering.moving_sum(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", (F.col("o_orderkey") % 2).cast("int"), F.lit(1), "o_totalprice", "moved")
    return out.select("o_orderkey", F.round("moved", 2).alias("moved"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 5")
def top_n_offset(spark, sf_dir):
    return ordering.limit(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, 5, ["-o_totalprice", "o_orderkey"])


@query("SELECT DISTINCT p_brand, p_size FROM part ORDER BY 1, 2")
def distinct_order(spark, sf_dir):
    return ordering.order_by(load(spark, sf_dir, "part").select("p_brand", "p_size").distinct(), "p_brand", "p_size")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rownum FROM orders")
def rownum_projection(spark, sf_dir):
    return ordering.with_rownum(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "rownum")


BOUNDED = {"region": 10, "nation": 10, "orders": 10, "supplier": 0}


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, least(count(*), {n}) AS n FROM {t}" for t, n in BOUNDED.items()))
def rownum_bound(spark, sf_dir):
    counted = [ordering.rownum_at_most(load(spark, sf_dir, t), n).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t, n in BOUNDED.items()]
    return reduce(lambda a, b: a.unionAll(b), counted)


def _keys(spark, sf_dir):
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    c, s = _keys(spark, sf_dir)
    return setops.combine(c, ("union all", s))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    c, s = _keys(spark, sf_dir)
    return setops.combine(c, ("union", s))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf_dir):
    c, s = _keys(spark, sf_dir)
    return setops.combine(c, ("intersect", s))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, sf_dir):
    c, s = _keys(spark, sf_dir)
    return setops.combine(c, ("intersect all", s))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def minus(spark, sf_dir):
    return setops.combine(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), ("minus", _keys(spark, sf_dir)[1]))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark, sf_dir):
    c, s = _keys(spark, sf_dir)
    return setops.combine(c, ("except all", s))


@query("""WITH per AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT a.o_custkey, round(a.total, 2) AS total FROM per a WHERE a.total > (SELECT 2 * avg(total) FROM per)""")
def with_factor_reused(spark, sf_dir):
    per = materialised(load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")), "factor")
    mean = F.broadcast(per.agg((2 * F.avg("total")).alias("bar")))
    return per.join(mean, F.col("total") > F.col("bar")).select("o_custkey", F.round("total", 2).alias("total"))


@query("SELECT s_suppkey, s_acctbal, round(2 * s_acctbal, 2) AS twice FROM supplier WHERE s_nationkey > 3")
def bind_parameters_view(spark, sf_dir):
    load(spark, sf_dir, "supplier").createOrReplaceTempView("supplier_view")
    return spark.sql("SELECT s_suppkey, s_acctbal, round(:factor * s_acctbal, 2) AS twice FROM supplier_view WHERE s_nationkey > :least", args={"factor": 2, "least": 3})


@query("""SELECT o_orderkey, (o_orderkey & 12) | 1 AS bits, xor(o_orderkey, 5) AS x, o_orderkey << 2 AS up, o_orderkey >> 1 AS down, -o_custkey AS neg, o_orderkey % 7 AS m, o_orderkey / 4.0 AS quarter FROM orders""")
def arithmetic_bits(spark, sf_dir):
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", k.bitwiseAND(F.lit(12)).bitwiseOR(F.lit(1)).alias("bits"), k.bitwiseXOR(F.lit(5)).alias("x"), F.shiftleft(k, 2).alias("up"), F.shiftright(k, 1).alias("down"), (-F.col("o_custkey")).alias("neg"), compat.mod(k, F.lit(7)).alias("m"), compat.divide(k, F.lit(4)).alias("quarter"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS s FROM part ORDER BY s ASC NULLS LAST, p_partkey")
def order_nulls(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("s"))
    return ordering.order_by(p, "s", "p_partkey")


@query("((SELECT n_nationkey::BIGINT AS k FROM nation UNION SELECT c_custkey FROM customer) INTERSECT SELECT o_custkey FROM orders) EXCEPT SELECT s_suppkey FROM supplier")
def set_precedence_and_types(spark, sf_dir):
    n, c = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), load(spark, sf_dir, "customer").select("c_custkey")
    return setops.combine(n, ("union", c), ("intersect", load(spark, sf_dir, "orders").select("o_custkey")), ("minus", load(spark, sf_dir, "supplier").select("s_suppkey")))


@query("SELECT vec_id, embedding[1] AS first_item, list_slice(embedding, 2, 4) AS part, len(embedding) AS n, unnest(embedding) AS each FROM embeddings", n="INTEGER")
def array_access_unnest(spark, sf_dir):
    e = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select("vec_id", F.element_at(e, 1).alias("first_item"), F.slice(e, 2, 3).alias("part"), F.size(e).alias("n"), F.explode(e).alias("each"))
