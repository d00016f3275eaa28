"""Queries over hierarchies, changes of tables, sources and sinks, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import dml, hierarchy
from lattica.plans.catalogue import query
from lattica.sources import tables
from lattica.sources.scratch import scratch_path
from lattica.sources.tables import load
from lattica.streaming import windows


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree: the world, its regions, their nations and their suppliers."""
    top = spark.range(1).select(F.lit("world").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("world").alias("name"))
    r = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit("world").alias("parent"), F.col("r_name").alias("name"))
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"))
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"), F.col("s_name").alias("name"))
    return top.unionAll(r).unionAll(n).unionAll(s)


PLACES = """places AS (SELECT 'world' AS id, NULL AS parent, 'world' AS name UNION ALL SELECT 'r' || r_regionkey, 'world', r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)"""


@query(f"""WITH RECURSIVE {PLACES}, tree AS (SELECT id, parent, name, 1 AS level, '/' || name AS path, id AS root FROM places WHERE parent IS NULL
    UNION ALL SELECT p.id, p.parent, p.name, t.level + 1, t.path || '/' || p.name, t.root FROM places p JOIN tree t ON p.parent = t.id)
    SELECT id, level, path, root, CASE WHEN id IN (SELECT parent FROM places WHERE parent IS NOT NULL) THEN 0 ELSE 1 END AS isleaf FROM tree""")
def connect_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    tree = hierarchy.connect_by(p, "id", "parent", p.parent.isNull(), path_of="name", order_siblings=["name"])
    return hierarchy.depth_first(tree).select("id", "level", "path", "root", F.col("connect_by_isleaf").alias("isleaf"))


@query(f"""WITH RECURSIVE {PLACES}, tree AS (SELECT id, 1 AS level FROM places WHERE id = 'r1' UNION ALL SELECT p.id, t.level + 1 FROM places p JOIN tree t ON p.parent = t.id)
    SELECT level, count(*) AS n FROM tree WHERE id <> 'n1' GROUP BY level""")
def connect_by_filtered(spark, sf_dir):
    """The WHERE takes a nation out and leaves what hangs below it."""
    p = places(spark, sf_dir)
    return hierarchy.connect_by(p, "id", "parent", p.id == "r1").filter("id <> 'n1'").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE p AS (SELECT 'r' AS kind, r_regionkey::BIGINT AS num, NULL AS up_kind, NULL::BIGINT AS up_num FROM region UNION ALL SELECT 'n', n_nationkey, 'r', n_regionkey FROM nation UNION ALL SELECT 's', s_suppkey, 'n', s_nationkey FROM supplier),
    tree AS (SELECT kind, num, 1 AS level FROM p WHERE up_kind IS NULL UNION ALL SELECT p.kind, p.num, t.level + 1 FROM p JOIN tree t ON p.up_kind = t.kind AND p.up_num = t.num AND p.num > t.num) SELECT kind, num, level FROM tree""")
def connect_by_two_keys(spark, sf_dir):
    """CONNECT BY PRIOR kind = up_kind AND PRIOR num = up_num AND num > PRIOR num."""
    none = F.lit(None)
    r = load(spark, sf_dir, "region").select(F.lit("r").alias("kind"), F.col("r_regionkey").cast("long").alias("num"), none.cast("string").alias("up_kind"), none.cast("long").alias("up_num"))
    n = load(spark, sf_dir, "nation").select(F.lit("n"), F.col("n_nationkey").cast("long"), F.lit("r"), F.col("n_regionkey").cast("long"))
    s = load(spark, sf_dir, "supplier").select(F.lit("s"), F.col("s_suppkey").cast("long"), F.lit("n"), F.col("s_nationkey").cast("long"))
    tree = hierarchy.connect_by(r.unionAll(n).unionAll(s), ["kind", "num"], ["up_kind", "up_num"], F.col("up_kind").isNull(), path_of="num", also=lambda prior, child: child("num") > prior("num"))
    return tree.select("kind", "num", "level")


@query("""WITH RECURSIVE ring AS (SELECT r_regionkey AS id, (r_regionkey + 4) % 5 AS parent FROM region),
    walk AS (SELECT id, 1 AS level, [id] AS ids FROM ring WHERE id = 0 UNION ALL SELECT r.id, w.level + 1, list_append(w.ids, r.id) FROM walk w JOIN ring r ON r.parent = w.id WHERE NOT list_contains(w.ids, r.id))
    SELECT w.id, w.level, max(CASE WHEN list_contains(w.ids, r.id) THEN 1 ELSE 0 END) AS iscycle FROM walk w LEFT JOIN ring r ON r.parent = w.id GROUP BY w.id, w.level""")
def connect_by_nocycle(spark, sf_dir):
    ring = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), ((F.col("r_regionkey") + 4) % 5).alias("parent"))
    return hierarchy.connect_by(ring, "id", "parent", F.col("id") == 0, nocycle=True).select("id", "level", F.col("connect_by_iscycle").alias("iscycle"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size + 1 ELSE p_size END AS p_size, round(CASE WHEN p_size > 40 THEN p_retailprice * p_size ELSE p_retailprice END, 2) AS p_retailprice FROM part")
def update_where(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return dml.update(p, {"p_size": F.col("p_size") + 1, "p_retailprice": F.col("p_retailprice") * F.col("p_size")}, F.col("p_size") > 40).withColumn("p_retailprice", F.round("p_retailprice", 2))


@query("SELECT c_custkey, round(c_acctbal + coalesce(t, 0), 2) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def update_from_join(spark, sf_dir):
    spent = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return dml.update_from(c, spent, ["c_custkey"], {"c_acctbal": F.col("t.c_acctbal") + F.col("s.spent")}).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND NOT (o_orderstatus = 'F' AND o_totalprice > 100000)")
def delete_using_and_where(spark, sf_dir):
    poor = load(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    left = dml.delete_using(load(spark, sf_dir, "orders"), poor, ["o_custkey"])
    return dml.delete(left, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)")
def delete_order_limit(spark, sf_dir):
    return dml.delete_first(load(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O", ["-o_totalprice", "o_orderkey"], 20, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 50000")
def delete_returning(spark, sf_dir):
    return dml.returning(load(spark, sf_dir, "orders"), (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 50000), "o_orderkey", "o_totalprice")


@query("SELECT 'large' AS into_, o_orderkey FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'urgent', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND NOT o_totalprice > 200000 UNION ALL SELECT 'rest', o_orderkey FROM orders WHERE NOT o_totalprice > 200000 AND o_orderpriority <> '1-URGENT'")
def insert_all_first(spark, sf_dir):
    key = F.col("o_orderkey")
    large, urgent, rest = dml.insert_all(load(spark, sf_dir, "orders"), (F.col("o_totalprice") > 200000, [F.lit("large").alias("into_"), key]), (F.col("o_orderpriority") == "1-URGENT", [F.lit("urgent").alias("into_"), key]), (None, [F.lit("rest").alias("into_"), key]), first=True)
    return large.unionAll(urgent).unionAll(rest)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def dump_and_external(spark, sf_dir):
    """Written as delimited text and read back through a declared schema."""
    path = scratch_path(spark, "dump")
    tables.dump(load(spark, sf_dir, "nation"), path, "|")
    return tables.external(spark, path, "n_nationkey INT, n_name STRING, n_regionkey INT", "|")


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS part FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-01' UNION ALL SELECT -1, '1995-03-01'")
def partitioned_table(spark, sf_dir):
    """A table made by interval partitions, appended to, and one partition read."""
    path = scratch_path(spark, "orders")
    o = tables.interval_partition(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", "part")
    tables.create_as(o, path, ["part"])
    tables.insert_into(spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit("1995-03-01").alias("part")), path, ["part"])
    return tables.partition(spark, path, "1995-03-01").select("o_orderkey", F.col("part").cast("string").alias("part"))


@query("SELECT CASE WHEN p_size < 10 THEN 'p1' WHEN p_size < 30 THEN 'p2' ELSE 'pmax' END AS part, count(*) AS n FROM part GROUP BY 1")
def range_partitions(spark, sf_dir):
    return tables.range_partition(load(spark, sf_dir, "part"), "p_size", [("p1", 10), ("p2", 30), ("pmax", None)]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


PRICES = [("low", 50000.0), ("mid", 150000.0), ("high", None)]


@query("""SELECT 'mid' AS part, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'begun' ELSE 'rest' END AS sub, o_orderkey FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 150000""")
def sub_partitions(spark, sf_dir):
    """A table by RANGE and LIST partitions, and the one for a price of 99999."""
    path = scratch_path(spark, "sub")
    o = tables.list_partition(tables.range_partition(load(spark, sf_dir, "orders"), "o_totalprice", PRICES), "o_orderstatus", {"begun": ["F", "P"], "rest": None}, "sub")
    tables.create_as(o.select("o_orderkey", "part", "sub"), path, ["part", "sub"])
    return tables.partition_for(spark, path, 99999.0, PRICES).select("part", "sub", "o_orderkey")


@query("SELECT count(*) AS n, 8 AS parts, count(DISTINCT o_custkey) AS keys FROM orders")
def hash_partitions(spark, sf_dir):
    """All rows in eight partitions, and each key in one."""
    o = tables.hash_partition(load(spark, sf_dir, "orders"), "o_custkey", 8)
    each = o.groupBy("part", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("n"), F.count_distinct("part").cast("int").alias("parts"), F.count(F.lit(1)).alias("keys"))


@query("SELECT count(*) AS n, max(o_orderdate) AS latest FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01'")
def flashback_as_of(spark, sf_dir):
    at = F.lit("1996-01-01").cast("timestamp")
    return tables.as_of(load(spark, sf_dir, "orders"), at, "o_orderdate").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("latest"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1996-01-01'")
def flashback_validity(spark, sf_dir):
    """Rows that say until when they hold."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").withColumn("until", F.col("o_orderdate") + F.expr("INTERVAL 30 DAY"))
    return tables.as_of(o, F.lit("1996-01-01").cast("timestamp_ntz"), "o_orderdate", "until").select("o_orderkey", "o_orderdate")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def export_import(spark, sf_dir):
    path = scratch_path(spark, "export")
    tables.export(load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey, 'X' AS DUMMY FROM nation")
def dual_row(spark, sf_dir):
    return load(spark, sf_dir, "nation").join(F.broadcast(tables.dual(spark))).select("n_nationkey", "DUMMY")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def tumbling_window(spark, sf_dir):
    return windows.tumbling(load(spark, sf_dir, "events"), "ts", "1 hour", "event_type", n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_window(spark, sf_dir):
    return windows.sessions(load(spark, sf_dir, "events"), "ts", "30 minutes", "user_id", n=F.count(F.lit(1)))


@query("""SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, count(*) AS n, max(value) AS top FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY s""")
def sliding_window(spark, sf_dir):
    return windows.sliding(load(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", n=F.count(F.lit(1)), top=F.max("value"))


@query("SELECT n_nationkey, u.range AS level FROM nation, range(1, 5) u WHERE u.range <= n_regionkey", level="INTEGER")
def connect_by_generator(spark, sf_dir):
    return hierarchy.generate(load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("n_regionkey").cast("int")).select("n_nationkey", "level")


def _stock(spark, sf_dir):
    """A target of customers who are not in debt, and a source of those with an order, with other balances."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    buyers = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return c.filter("c_acctbal >= 0"), c.join(buyers, "c_custkey", "left_semi").withColumn("c_acctbal", F.col("c_acctbal") + 1000)


STOCK = "s AS (SELECT *, c_custkey IN (SELECT o_custkey FROM orders) AS fresh, c_acctbal >= 0 AS held FROM customer)"


@query(f"""WITH {STOCK} SELECT c_custkey, c_mktsegment, round(CASE WHEN fresh AND c_mktsegment <> 'BUILDING' THEN c_acctbal + c_acctbal + 1000 ELSE c_acctbal END, 2) AS c_acctbal FROM s WHERE held
    UNION ALL SELECT c_custkey, 'NEW', round(c_acctbal + 1000, 2) FROM s WHERE fresh AND NOT held AND c_acctbal + 1000 > 500""")
def merge_into(spark, sf_dir):
    target, source = _stock(spark, sf_dir)
    out = dml.merge(
        target, source, ["c_custkey"], update={"c_acctbal": F.col("t.c_acctbal") + F.col("s.c_acctbal")}, update_where=F.col("t.c_mktsegment") != "BUILDING",
        insert={"c_custkey": F.col("s.c_custkey"), "c_mktsegment": F.lit("NEW"), "c_acctbal": F.col("s.c_acctbal")}, insert_where=F.col("s.c_acctbal") > 500,
    )
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(f"WITH {STOCK} SELECT c_custkey, c_mktsegment, round(CASE WHEN fresh THEN c_acctbal + 1000 ELSE c_acctbal END, 2) AS c_acctbal FROM s WHERE held OR fresh")
def replace_into(spark, sf_dir):
    return dml.upsert(*_stock(spark, sf_dir), ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(f"WITH {STOCK} SELECT c_custkey, CASE WHEN held AND fresh THEN 'seen' ELSE c_mktsegment END AS c_mktsegment, round(CASE WHEN held THEN c_acctbal ELSE c_acctbal + 1000 END, 2) AS c_acctbal FROM s WHERE held OR fresh")
def insert_on_duplicate_key(spark, sf_dir):
    return dml.upsert(*_stock(spark, sf_dir), ["c_custkey"], update={"c_mktsegment": F.lit("seen")}).withColumn("c_acctbal", F.round("c_acctbal", 2))
