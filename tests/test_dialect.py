"""Rules of the dialect over several keys, odd frames, repeated keys and nulls, against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import compat, misc
from lattica.functions.registry import Unsupported, aliases, dialect
from lattica.operators import dml, frames, hierarchy, joins, ordering
from lattica.plans import catalogue
from lattica.sources import scratch
from lattica.sources.json_table import json_table
from tests.oracles import connect, difference


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_lists_of_empty_texts_and_descending_keys(spark):
    rows = spark.createDataFrame([(1, "", 3), (1, "", 1), (2, None, 1), (3, "b", None), (3, "a", 2), (3, "c", 2)], "g int, v string, k int")
    got = {r.g: r for r in rows.groupBy("g").agg(compat.group_concat(F.col("v"), "|").alias("a"), compat.group_concat(F.col("v"), "|", ["-k", "v"]).alias("b"), compat.group_concat(F.col("v"), "|", [("k", False), ("v", True)]).alias("c")).collect()}
    assert (got[1].a, got[2].a) == ("|", None)
    assert (got[3].a, got[3].b, got[3].c) == ("a|b|c", "b|a|c", "c|a|b")


def test_hypothetical_places_with_nulls(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, None), (2, 1.0), (None, 5.0)], "a int, b double")
    got = rows.agg(compat.rank_of([1, 2.0], ["a", "-b"]).alias("r"), compat.dense_rank_of(2, "a").alias("d"), compat.rank_of(0, "-a").alias("down"), compat.cume_dist_of([1, 2.0], ["a", "b"]).alias("c")).first()
    assert got == (2, 2, 5, 0.4)


@pytest.mark.parametrize("kind", ["rows", "range"])
def test_moving_frames_against_plain(spark, kind):
    random.seed(1)
    data = [(i, random.choice("xy"), random.randint(0, 40), random.choice([None, *range(-5, 6)]), random.randint(0, 9), random.choice([None, 0, 1, 7])) for i in range(300)]
    df = spark.createDataFrame(data, "id int, g string, k int, v int, before int, after int")
    wanted = {"total": ("sum", "v"), "n": ("count", "v"), "mean": ("avg", "v"), "least": ("min", "v"), "most": ("max", "v")}
    out = frames.moving(df, ["g"], ["k", "id"] if kind == "rows" else "k", F.col("before"), F.col("after"), wanted, frame=kind)
    got = {r.id: (r.total, r.n, r.mean, r.least, r.most) for r in out.collect()}
    order = sorted(data, key=lambda r: (r[1], r[2], r[0]))
    for i, g, k, _, before, after in data:
        mine = [r for r in order if r[1] == g]
        if after is None:
            values = []
        elif kind == "rows":
            at = next(n for n, r in enumerate(mine) if r[0] == i)
            values = [r[3] for r in mine[max(0, at - before) : at + after + 1] if r[3] is not None]
        else:
            values = [r[3] for r in mine if k - before <= r[2] <= k + after and r[3] is not None]
        assert got[i] == ((sum(values), len(values), sum(values) / len(values), min(values), max(values)) if values else (None, 0, None, None, None))


def test_moving_frames_send_nothing_through_the_driver(spark, monkeypatch):
    """Both sides of each join grow with the rows, however small their files look: none may be planned as a broadcast."""
    plans, write = [], frames.materialised

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(frames, "materialised", noted)
    df = spark.range(400).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("k"), F.lit(1).alias("v"))
    out = frames.moving(df, ["g"], "k", F.col("k"), F.col("k"), {"n": ("count", "v")}, frame="range")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
    assert out.agg(F.sum("n")).first()[0] == sum(1 for a in range(400) for b in range(400) if a % 3 == b % 3 and 0 <= b % 50 <= 2 * (a % 50))


def test_short_moving_frames_take_no_join(spark, monkeypatch):
    """Frames of few rows: one sort, no join and no scratch table; the same rows as from blocks, also for bounds on one side of the row and frames that are empty."""
    wrote, write = [], frames.materialised
    monkeypatch.setattr(frames, "materialised", lambda df, name: wrote.append(name) or write(df, name))
    k = F.col("id")
    df = spark.range(200).select("id", (k % 3).alias("g"), F.when(k % 4 > 0, k * 7 % 23).alias("i"), (k * 5 % 17).cast("decimal(9, 2)").alias("d"), (k % 11 - 4).alias("before"), F.when(k % 5 > 0, k % 8 - 3).alias("after"))
    wanted = {f"{kind}_{c}": (kind, c) for kind in ("sum", "count", "avg", "min", "max") for c in ("i", "d")}

    def rows(before, after):
        return frames.moving(df, ["g"], ["-id"], before, after, wanted)

    bounds = [(F.col("before"), F.col("after")), (F.lit(-20), F.col("after") + 25), (F.lit(0), F.lit(-1)), (F.lit(3), F.lit(None).cast("int"))]
    short = [rows(*b) for b in bounds]
    assert not wrote and not any("Join" in x._jdf.queryExecution().executedPlan().toString() for x in short)
    monkeypatch.setattr(frames, "SHORT", 0)
    for b, x in zip(bounds, short, strict=True):
        y = rows(*b)
        assert x.dtypes == y.dtypes and sorted(x.collect(), key=lambda r: r.id) == sorted(y.collect(), key=lambda r: r.id)
    assert wrote


def test_moving_sums_lose_no_digits(spark):
    df = spark.createDataFrame([(1, 1e17), (2, 1.0), (3, 1.0), (4, None), (5, float("nan")), (6, 2.0)], "k int, v double").withColumn("g", F.lit(1))
    got = [r.s for r in ordering.moving_sum(df, ["g"], "k", F.lit(0), F.lit(0), "v", "s").orderBy("k").collect()]
    assert got[:4] == [1e17, 1.0, 1.0, None] and got[4] != got[4] and got[5] == 2.0


def test_merge_of_repeated_source_keys_fails(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (3, "w")], "k int, v string")
    new = {"k": F.col("s.k"), "v": F.col("s.v")}
    with pytest.raises(Exception, match="several rows for one key"):
        dml.merge(target, source, ["k"], update={"v": F.col("s.v")}, insert=new).collect()
    assert sorted(map(tuple, dml.merge(target, source.filter("k = 3"), ["k"], update={"v": F.col("s.v")}, insert=new).collect())) == [(1, "a"), (2, "b"), (3, "w"), (3, "z")]
    with pytest.raises(Exception, match="several rows for one key"):
        dml.upsert(target, source.filter("k = 3"), ["k"]).collect()
    once = dml.latest(source, ["k"], ["-v"])
    assert sorted(map(tuple, dml.upsert(target, once, ["k"]).collect())) == [(1, "y"), (2, "b"), (3, "z")]


def test_update_of_the_first_rows(spark):
    rows = spark.createDataFrame([(1, 5, 0), (2, 3, 0), (3, 4, 0)], "k int, v int, _hit0 int")
    got = dml.update_first(rows, {"_hit0": F.lit(9)}, F.col("v") > 3, ["v"], 1, ["k"])
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == [(1, 5, 0), (2, 3, 0), (3, 4, 9)]


def test_row_numbers_without_keys_and_with_one_key(spark):
    rows = spark.range(1000).repartition(7)
    assert sorted(r.rownum for r in ordering.with_rownum(rows).collect()) == list(range(1, 1001))
    tied = rows.withColumn("same", F.lit(1))
    numbered = ordering.with_rownum(tied, "same")
    assert sorted(r.rownum for r in numbered.collect()) == list(range(1, 1001))
    dealt = tied.repartitionByRange(4, *ordering.keys("same"), F.xxhash64("id", "same")).select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert dealt.count() == 4 and dealt.agg(F.max("count")).first()[0] < 500


@pytest.mark.parametrize("width", [1, 2, 3])
def test_not_in_over_several_keys_against_plain(spark, width):
    random.seed(width)
    names = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{n} int" for n in names)

    def rows(n):
        return [tuple(random.choice([None, 1, 2, 3, 4]) for _ in names) for _ in range(n)]

    def unequal(a, b):
        return any(x is not None and y is not None and x != y for x, y in zip(a, b, strict=True))

    for size in (0, 1, 3, 12):
        left, right = rows(40), rows(size)
        got = joins.not_in(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), names)
        want = [r for r in left if all(unequal(r, s) for s in right)]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_not_in_over_several_keys_has_no_nested_loop_over_rows(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    plan = joins.not_in(df, df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 4 and plan.count("LeftAnti, ((_lk") == plan.count("rightHint=(strategy=broadcast)") == 1


def test_range_join_against_plain(spark):
    random.seed(2)
    points = [(i, random.uniform(-50, 1050)) for i in range(300)]
    ranges = [(i, low, low + random.choice([-1, 0, 0.5, 3, 40, 900])) for i, low in enumerate(random.uniform(-40, 1000) for _ in range(80))]
    p, r = spark.createDataFrame(points, "p int, at double"), spark.createDataFrame(ranges, "r int, low double, high double")
    got = sorted((x.p, x.r) for x in joins.range_join(p, r, "at", "low", "high", 2.0).collect())
    assert got == sorted((i, j) for (i, at), (j, low, high) in itertools.product(points, ranges) if low <= at < high)
    assert joins.range_join(p, r.limit(0), "at", "low", "high", 2.0).count() == 0


def test_numbers_as_text(spark):
    d = F.lit("1234.500").cast("decimal(18,3)")
    got = one(spark, *(misc.number_text(x, f).alias(f"t{i}") for i, (x, f) in enumerate([(d, None), (F.lit(70), None), (-d, "9,999.90"), (d, "9999.99"), (F.lit(7), "000"), (F.lit("12.5"), "99.0"), (F.lit(None).cast("int"), None)])))
    assert tuple(got) == ("1234.5", "70", "-1,234.50", "1234.50", "007", "12.5", None)
    assert one(spark, compat.arithmetic("-", "10.5", F.lit(1)).cast("string").alias("x")).x.startswith("9.5") and one(spark, compat.compare("<", F.lit("9"), F.lit(10)).alias("x")).x


def test_rounding_goes_by_type(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2020-05-06 13:48:09' AS d, 2.567D AS x")
    r, t = dialect("round", df), dialect("trunc", df)
    got = df.select(r(F.col("d")).cast("string").alias("a"), t(F.col("d")).cast("string").alias("b"), r(F.col("x"), 1).alias("c"), t(F.col("x"), 1).alias("e"), dialect("trunc")(F.col("d"), "MM").cast("string").alias("f")).first()
    assert tuple(got) == ("2020-05-07 00:00:00", "2020-05-06 00:00:00", 2.6, 2.5, "2020-05-01 00:00:00")


def test_aliases_hold_inside_only(spark):
    with aliases({"Shout": "UPPER"}):
        assert one(spark, dialect("shout")(F.lit("a")).alias("x")).x == "A"
    with pytest.raises(KeyError):
        dialect("shout")
    with pytest.raises(ValueError, match="own name"), aliases({"upper": "lower"}):
        pass
    with pytest.raises(Unsupported):
        dialect("get_lock")


def test_json_table_on_error(spark):
    docs = spark.createDataFrame([('{"l": [{"v": 1}, {"v": [2]}, {}]}',)], "doc string")
    got = json_table(docs, "doc", "$.l[*]", {"v": ("int", "$.v")})
    assert [r.v for r in got.collect()] == [1, None, None]
    with pytest.raises(Exception, match="no scalar"):
        json_table(docs, "doc", "$.l[*]", {"v": ("int", "$.v")}, on_error="error").collect()
    fine = spark.createDataFrame([('{"l": [{"v": 1}, {}]}',)], "doc string")
    assert [r.v for r in json_table(fine, "doc", "$.l[*]", {"v": ("int", "$.v")}, on_error="error").collect()] == [1, None]


def test_positions_of_matches(spark):
    at = dialect("regexp_instr")
    got = one(spark, *(at(F.lit("ab12cd345"), "[0-9]+", *rest).alias(f"x{i}") for i, rest in enumerate([(), (1, 2), (1, 2, 1), (4,), (1, 3), (1, 1, 1)])))
    assert tuple(got) == (3, 7, 10, 4, 0, 5)


def test_a_deep_chain_keeps_all_its_levels(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)], "id int, parent int")
    assert hierarchy.connect_by(chain, "id", "parent", F.col("parent").isNull()).agg(F.max("level")).first()[0] == 12


def test_scratch_tables_go_but_for_the_last(spark):
    start = scratch.mark()
    first = scratch.materialised(spark.range(3), "a")
    last = scratch.materialised(first, "b")
    scratch.clear_since(spark, start)
    assert last.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        first.count()


def test_number_formats_of_signed_fractions(spark):
    """The zero before the point stays behind a sign."""
    df = spark.createDataFrame([(1, "-0.5"), (2, "0.5"), (3, "-12.25")], "k int, v string").withColumn("v", F.col("v").cast("decimal(9, 2)"))
    formats = ("990.00", "S990.00", "MI990.00", "990.00MI", "990.00S", "990.00PR")
    got = df.orderBy("k").select(*(dialect("to_char")(F.col("v"), f).alias(f) for f in formats)).collect()
    assert [tuple(r) for r in got] == [("-0.50", "-0.50", "-0.50", "0.50-", "0.50-", "<0.50>"), ("0.50", "+0.50", "0.50", "0.50", "0.50+", "0.50"), ("-12.25", "-12.25", "-12.25", "12.25-", "12.25-", "<12.25>")]


def test_number_texts_of_odd_customers(spark, tmp_path):
    """Fractions below zero, keys that are wider than their format and balances between two cents, against the SQL."""
    odd = [(1, -0.5), (1000000007, -0.01), (-5, 0.0), (-1234567890, 1234567890123.25), (999999999, 4000.501), (None, None), (7, 2.675), (8, 0.125), (9, 1.005), (10, -2.665)]
    spark.createDataFrame([(k, "n", 1, x, "m") for k, x in odd], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    name = "number_texts_and_casts"
    assert difference(catalogue.QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), catalogue.ORACLES[name]) == ""
