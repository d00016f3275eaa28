"""The dialect's value rules, one by one."""

import inspect
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lattica.functions import compat, dates, jsonx, misc, registry, strings
from lattica.operators import grouping, hierarchy, ordering, setops
from lattica.sources import json_table, tables


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("v")).first().v


def ts(text):
    return F.lit(text).cast("timestamp")


def null():
    return F.lit(None).cast("string")


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: compat.cat(null(), F.lit("b")), "b"),
        (lambda: compat.cat(null(), null()), None),
        (lambda: compat.cat(F.lit(1), F.lit("x")), "1x"),
        (lambda: compat.mod(F.lit(7), F.lit(0)), 7),
        (lambda: compat.mod(F.lit(-7), F.lit(3)), -1),
        (lambda: compat.divide(F.lit(1), F.lit(4)), 0.25),
        (lambda: compat.divide(F.lit(1), F.lit(0), zero_is_null=True), None),
        (lambda: compat.greatest(F.lit(1), F.lit(None).cast("int")), None),
        (lambda: compat.greatest(F.lit(1), F.lit(3)), 3),
        (lambda: compat.least(F.lit(1), F.lit(3)), 1),
        (lambda: compat.decode(null(), None, "null", "a", "A"), "null"),
        (lambda: compat.decode(F.lit("b"), "a", "A"), None),
        (lambda: compat.lnnvl(F.lit(None).cast("boolean")), True),
        (lambda: compat.nvl2(null(), 1, 2), 2),
        (lambda: compat.empty_as_null(F.lit("")), None),
        (lambda: strings.substr(F.lit("hello"), 0, 2), "he"),
        (lambda: strings.substr(F.lit("hello"), -3, 2), "ll"),
        (lambda: strings.substr(F.lit("hello"), 2), "ello"),
        (lambda: strings.substr(F.lit("hello"), 2, 0), ""),
        (lambda: strings.substr(F.lit("hello"), 9, 2), ""),
        (lambda: strings.substr(null(), 1, 2), None),
        (lambda: strings.substrb(F.lit("aéb"), 2, 2), "é"),
        (lambda: strings.instr(F.lit("banana"), "an", 1, 2), 4),
        (lambda: strings.instr(F.lit("banana"), "a", -1), 6),
        (lambda: strings.instr(F.lit("banana"), "a", -1, 2), 4),
        (lambda: strings.instr(F.lit("banana"), "x", 2), 0),
        (lambda: strings.instrb(F.lit("éab"), "a"), 3),
        (lambda: strings.replace(F.lit("aXbX"), "X"), "ab"),
        (lambda: strings.replace(F.lit("aXb"), null()), "aXb"),
        (lambda: strings.insert(F.lit("Quadratic"), 3, 4, "What"), "QuWhattic"),
        (lambda: strings.insert(F.lit("abc"), 9, 1, "z"), "abc"),
        (lambda: strings.trim_set(F.lit("xyab"), "xy", "leading"), "ab"),
        (lambda: strings.isnumeric(F.lit("1.5e3")), 1),
        (lambda: strings.isnumeric(F.lit("1x")), 0),
        (lambda: strings.asciistr(F.lit("aé")), "a\\00E9"),
        (lambda: strings.to_multi_byte(F.lit("a1")), "ａ１"),
        (lambda: strings.to_single_byte(F.lit("ａ１")), "a1"),
        (lambda: strings.regexp_like(F.lit("ABC"), "b", "i"), True),
        (lambda: strings.regexp_count(F.lit("a1b22"), "[0-9]+"), 2),
        (lambda: strings.regexp_instr(F.lit("ab12cd34"), "[0-9]+"), 3),
        (lambda: strings.regexp_instr(F.lit("ab12cd34"), "[0-9]+", 1, 2), 7),
        (lambda: strings.regexp_instr(F.lit("ab12cd34"), "[0-9]+", 1, 1, 1), 5),
        (lambda: strings.regexp_substr(F.lit("ab12cd34"), "[0-9]+", 1, 2), "34"),
        (lambda: strings.regexp_replace(F.lit("a1b2c3"), "[0-9]", "#", 1, 2), "a1b#c3"),
        (lambda: strings.regexp_replace(F.lit("a1b2c3"), "[0-9]", "#", 3), "a1b#c#"),
        (lambda: dates.add_months(ts("2023-02-28 10:00:00"), 1), datetime(2023, 3, 31, 10)),
        (lambda: dates.add_months(ts("2024-01-30 00:00:00"), 1), datetime(2024, 2, 29)),
        (lambda: dates.last_day(ts("2024-02-03 04:05:06")), datetime(2024, 2, 29, 4, 5, 6)),
        (lambda: dates.next_day(ts("2024-02-03 04:00:00"), 2), datetime(2024, 2, 5, 4)),
        (lambda: dates.days_between(ts("2024-01-02 12:00:00"), ts("2024-01-01 00:00:00")), 1.5),
        (lambda: dates.add_days(ts("2024-01-01 00:00:00"), 0.25), datetime(2024, 1, 1, 6)),
        (lambda: dates.trunc(ts("2024-05-17 13:00:00"), "Q"), datetime(2024, 4, 1)),
        (lambda: dates.trunc(ts("2024-05-17 13:00:00"), "CC"), datetime(2001, 1, 1)),
        (lambda: dates.trunc(ts("2024-05-17 13:00:00"), "D"), datetime(2024, 5, 12)),
        (lambda: dates.round_date(ts("2024-05-17 12:00:00")), datetime(2024, 5, 18)),
        (lambda: dates.round_date(ts("2024-05-16 00:00:00"), "MM"), datetime(2024, 6, 1)),
        (lambda: dates.round_date(ts("2024-07-01 00:00:00"), "YYYY"), datetime(2025, 1, 1)),
        (lambda: dates.round_date(ts("2024-05-16 00:00:00"), "Q"), datetime(2024, 7, 1)),
        (lambda: dates.to_char(ts("2024-05-07 13:04:05"), 'YYYY"y" MM DD HH12:MI:SS Q W WW CC RM'), "2024y 05 07 01:04:05 2 1 19 21 V"),
        (lambda: dates.to_char(ts("2024-05-07 00:01:01"), "SSSSS DDD DY"), "00061 128 TUE"),
        (lambda: dates.to_date(F.lit("2024/05/07 23"), "YYYY/MM/DD HH24"), datetime(2024, 5, 7, 23)),
        (lambda: dates.timestampdiff("MONTH", ts("2024-01-31 00:00:00"), ts("2024-03-01 00:00:00")), 1),
        (lambda: dates.timestampdiff("HOUR", ts("2024-01-01 00:30:00"), ts("2024-01-01 02:29:00")), 1),
        (lambda: dates.from_unixtime(F.lit(0), "%Y-%m-%d %H:%i:%s"), "1970-01-01 00:00:00"),
        (lambda: misc.trunc_number(F.lit(-2.79), 1), -2.7),
        (lambda: misc.trunc_number(F.lit(1234.0), -2), 1200.0),
        (lambda: misc.log(F.lit(2), F.lit(8)), 3.0),
        (lambda: misc.inet_aton(F.lit("10.0.0.1")), 167772161),
        (lambda: misc.inet_aton(F.lit("10.0.0.256")), None),
        (lambda: misc.inet_ntoa(F.lit(167772161)), "10.0.0.1"),
        (lambda: misc.to_number(F.lit(" 1.5 "), 10, 2), Decimal("1.50")),
        (lambda: misc.array_length(F.lit(None).cast("array<int>")), 0),
        (lambda: jsonx.json_value(F.lit('{"a":{"b":[1,2]}}'), "$.a.b[1]", "int"), 2),
        (lambda: jsonx.json_value(F.lit('{"a":[1]}'), "$.a"), None),
        (lambda: jsonx.json_value(F.lit("not json"), "$.a"), None),
        (lambda: jsonx.json_query(F.lit('{"a":"x"}'), "$.a"), None),
        (lambda: jsonx.json_query(F.lit('{"a":"x"}'), "$.a", "with"), '["x"]'),
        (lambda: jsonx.json_query(F.lit('{"a":[1]}'), "$.a", "conditional"), "[1]"),
        (lambda: jsonx.json_query(F.lit("{}"), "$.a", on_error="empty"), "[]"),
        (lambda: jsonx.json_exists(F.lit('{"a":null}'), "$.a"), True),
        (lambda: jsonx.json_exists(F.lit("{}"), "$.a"), False),
        (lambda: jsonx.is_json(F.lit("{")), False),
        (lambda: jsonx.json_array(F.lit(1), F.lit(None).cast("int"), absent_on_null=False), "[1,null]"),
        (lambda: jsonx.json_object("a", F.lit(None).cast("int")), '{"a":null}'),
        (lambda: jsonx.json_object("a", F.lit(None).cast("int"), absent_on_null=True), "{}"),
        (lambda: jsonx.json_mergepatch(F.lit('{"a":1,"b":{"c":2}}'), F.lit('{"a":null,"b":{"d":3}}')), '{"b":{"c":2,"d":3}}'),
        (lambda: jsonx.json_set(F.lit('{"a":[1]}'), "$.a[0]", F.lit("9")), '{"a":[9]}'),
        (lambda: jsonx.json_set(F.lit("{}"), "$.n", F.lit("1"), create=False), "{}"),
    ],
)
def test_value(one, make, want):
    got = value(one, make())
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_errors(one):
    for bad in (compat.divide(F.lit(1), F.lit(0)), jsonx.json_value(F.lit("{}"), "$.a", on_error="error")):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO|no value"):
            value(one, bad)
    with pytest.raises(ValueError, match="path"):
        jsonx.steps("a.b")


def test_registry(one):
    assert len(registry.FUNCTIONS) + len(registry.ELSEWHERE) + len(registry.UNSUPPORTED) == 189
    assert value(one, registry.dialect("SUBSTR")(F.lit("abc"), 2)) == "bc"
    for name in ("get_lock", "found_rows"):
        with pytest.raises(registry.Unsupported):
            registry.dialect(name)
    with pytest.raises(KeyError):
        registry.dialect("no_such_function")


def test_nulls_order(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, v int")
    assert [r.k for r in ordering.order_by(df, "v").collect()] == [1, 3, 2]
    assert [r.k for r in ordering.order_by(df, "-v").collect()] == [2, 3, 1]
    with pytest.raises(ValueError, match="whole"):
        ordering.limit(df, -1)


def test_spread(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (2, 3.0)], "g int, x double")
    got = {r.g: (r.s, r.t) for r in df.groupBy("g").agg(compat.stddev(F.col("x")).alias("s"), F.stddev_samp("x").alias("t")).collect()}
    assert got[1] == (0.0, None) and got[2][0] == pytest.approx(2**0.5)


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x int") for xs in ([1, 1, 2, 3], [1, 2, 2]))
    assert sorted(r.x for r in setops.combine(a, ("intersect all", b)).collect()) == [1, 2]
    assert sorted(r.x for r in setops.combine(a, ("except all", b)).collect()) == [1, 3]
    assert sorted(r.x for r in setops.combine(a, ("union", b), ("minus", b)).collect()) == [3]
    with pytest.raises(ValueError, match="columns"):
        setops.combine(a, ("union", b.withColumn("y", F.lit(1))))
    with pytest.raises(TypeError):
        setops.combine(a, ("union", spark.createDataFrame([("s",)], "x string")))
    assert setops.combine(a, ("union all", b.select(F.col("x").cast("decimal(5,2)")))).schema["x"].dataType.simpleString() == "decimal(22,2)"


def test_grouping_sets():
    assert grouping.rollup_sets(["a", "b"]) == [["a", "b"], ["a"], []]
    assert grouping.cube_sets(["a", "b"]) == [["a", "b"], ["a"], ["b"], []]
    assert grouping.combined_sets([["a"]], [["b"], []]) == [["a", "b"], ["a"]]


def test_cycle(spark):
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id int, parent int")
    with pytest.raises(hierarchy.CycleError):
        hierarchy.connect_by(ring, "id", "parent", F.col("id") == 1)
    got = {r.id: (r.level, r.connect_by_iscycle) for r in hierarchy.connect_by(ring, "id", "parent", F.col("id") == 1, nocycle=True).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 1)}


def test_levels(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 6)], "id int, parent int")
    with pytest.raises(ValueError, match="more than 3 levels"):
        hierarchy.connect_by(chain, "id", "parent", F.col("id") == 1, levels=3)
    assert hierarchy.connect_by(chain, "id", "parent", F.col("id") == 1, levels=5).count() == 5
    assert inspect.signature(hierarchy.connect_by).parameters["levels"].default is None


def test_siblings(spark):
    tree = spark.createDataFrame([(1, None, "top"), (2, 1, "b"), (3, 1, "a"), (4, 2, "c")], "id int, parent int, name string")
    got = hierarchy.depth_first(hierarchy.connect_by(tree, "id", "parent", F.col("parent").isNull(), path_of="name", order_siblings=["name"])).collect()
    assert [(r.id, r.path) for r in got] == [(1, "/top"), (3, "/top/a"), (2, "/top/b"), (4, "/top/b/c")]


def test_json_table(spark):
    df = spark.createDataFrame([(1, '{"i":[{"a":1,"b":[2]},{"a":"x"}]}'), (2, "{}"), (3, None)], "k int, j string")
    columns = {"a": ("int", "$.a"), "has_b": ("exists", "$.b"), "b": ("query", "$.b")}
    got = sorted(((r.k, r.a, r.has_b, r.b, r.n) for r in json_table.json_table(df, "j", "$.i[*]", columns, ordinality="n").collect()), key=lambda r: r[-1])
    assert got == [(1, 1, 1, "[2]", 1), (1, None, 0, None, 2)]
    assert json_table.json_table(df, "j", "$.i[*]", columns, outer=True).count() == 4


def test_external(spark, tmp_path):
    (tmp_path / "x.data").write_text("1, 2.5,abc,2020-01-02 03:04:05^\n2,,  ,^\n")
    got = tables.external(spark, str(tmp_path / "x.data"), "a int, b decimal(5,2), c string, d timestamp_ntz", records="^\n").collect()
    assert [tuple(r) for r in got] == [(1, Decimal("2.50"), "abc", datetime(2020, 1, 2, 3, 4, 5)), (2, None, None, None)]


def test_pruning(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create_as(tables.range_partition(spark.range(100), "id", [("p1", 10), ("pmax", None)]), path, ["part"])
    plan = tables.partition(spark, path, "p1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and tables.partition(spark, path, "p1").count() == 10


def test_moving_sum(spark):
    rows = [(p, k, float(k % 5) if k % 4 else None, k % 3) for p in ("a", "b", None) for k in range(12)]
    df = spark.createDataFrame(rows, "p string, k int, x double, s int")
    got = {(r.p, r.k): r.m for r in ordering.moving_sum(df, ["p"], "k", F.col("s"), F.lit(1), "x", "m").collect()}
    assert got == {(p, k): sum(x or 0 for q, j, x, _ in rows if q == p and k - s <= j <= k + 1) for p, k, _, s in rows}


def test_nulls_for_empty(spark):
    df = spark.createDataFrame([("", 1), ("x", 2)], "s string, n int")
    assert [tuple(r) for r in compat.nulls_for_empty(df).collect()] == [(None, 1), ("x", 2)]
