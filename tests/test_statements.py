"""Statements, SQL functions and functions of the user's own."""

import uuid

import pandas as pd
import pytest

from lattica.functions import sql, user
from lattica.operators import statements


def test_types():
    assert [statements.spark_type(t) for t in ("number(8, 2)", "NUMBER(8)", "varchar(20)", "INT[]", "timestamp(6)", "TIMESTAMP(3) WITH LOCAL TIME ZONE")] == ["decimal(8,2)", "decimal(8,0)", "string", "array<int>", "timestamp_ntz", "timestamp"]


def test_tables(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    statements.create_table(spark, name, {"a": "NUMBER(8)", "d": "DATE", "p": "VARCHAR(3)"}, ["p"], str(tmp_path / "t"))
    spark.sql(f"INSERT INTO {name} VALUES (1, timestamp_ntz'2020-01-02 03:04:05', 'x')")
    statements.synonym(spark, "same", name)
    assert spark.sql("SELECT a, hour(d) FROM same").first() == (1, 3)
    statements.analyze(spark, name, "a")
    statements.drop_table(spark, name)
    statements.drop_table(spark, name, if_exists=True)


def test_sequence(spark):
    got = statements.numbered(spark.range(50), "-id", start=10, step=5).collect()
    assert sorted((r.id, r.nextval) for r in got) == [(i, 10 + 5 * (49 - i)) for i in range(50)]


def test_hints_and_settings(spark):
    df = spark.range(3)
    assert statements.hint(df, "use_concat") is df and statements.hint(df, "materialize").count() == 3
    assert "hint" in statements.hint(df, "use_hash")._jdf.queryExecution().logical().toString().lower()
    with pytest.raises(ValueError, match="hint"):
        statements.hint(df, "nonsense")
    assert statements.alter_session(spark, "time_zone", "UTC") and not statements.alter_session(spark, "nls_calendar", "x")


def test_sql_functions(spark):
    before = spark.conf.get("spark.sql.legacy.setopsPrecedence.enabled")
    assert len(sql.register(spark)) == len(sql.DEFINITIONS)
    got = spark.sql("""SELECT lnnvl(NULL), d_substr('hello', 0, 2), d_substr('hello', -3), d_substr('x', 1, 0), d_mod(7, 0), cat(NULL, 'b'), d_add_months(timestamp'2023-02-28 10:00:00', 1) = timestamp'2023-03-31 10:00:00',
        inet_aton('10.0.0.1'), inet_ntoa(167772161), d_greatest(1, NULL), json_value('{"a":1}', '$.a'), json_value('{"a":[1]}', '$.a'), isnumeric('1e3'), d_trunc(-2.79, 1), bitxor(5, 1), d_replace('aXb', 'X')""").first()
    assert tuple(got) == (True, "he", "llo", "", 7.0, "b", True, 167772161, "10.0.0.1", None, "1", None, 1, -2.7, 4, "ab")
    assert [r[0] for r in spark.sql("SELECT 1 UNION SELECT 2 INTERSECT SELECT 2").collect()] == [2]
    spark.conf.set("spark.sql.legacy.setopsPrecedence.enabled", before)


def test_user_functions(spark):
    def plus(x: pd.Series) -> pd.Series:
        return x + 1

    def mean(x: pd.Series) -> float:
        return float(x.mean())

    class Pieces:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    user.scalar(spark, "shout", lambda s: s.upper() + "!", "string")
    user.vectorised(spark, "plus_one", plus, "bigint")
    user.vectorised(spark, "own_mean", mean, "double")
    user.table(spark, "pieces", Pieces, "i int")
    user.expression(spark, "twice(x INT)", "INT", "2 * x")
    assert spark.sql("SELECT shout('a'), twice(4), max(plus_one(id)) FROM range(5)").first() == ("A!", 8, 5)
    assert spark.sql("SELECT own_mean(id) FROM range(5)").first() == (2.0,)
    assert spark.sql("SELECT id, i FROM range(3), LATERAL pieces(CAST(id AS INT))").count() == 3
