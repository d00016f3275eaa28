"""Reading and writing tables: Parquet with its own schema, delimited files with a declared one, partitions, JDBC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.sources.ship import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views over the tables, for SQL text."""
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


def dual(spark: SparkSession) -> DataFrame:
    """The one-row relation."""
    return spark.range(1).select(F.lit("X").alias("DUMMY"))


def external(spark: SparkSession, path: str, schema: StructType | str, fields: str = ",", records: str | None = None, header: bool = False) -> DataFrame:
    """An external table: delimited text with a declared schema. Blank fields are null, surplus ones are dropped, a record that doesn't fit keeps what can be read."""
    reader = spark.read.schema(schema).option("sep", fields).option("header", header).option("mode", "PERMISSIVE").option("nullValue", "").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    return (reader.option("lineSep", records) if records else reader).csv(path)


def dump(df: DataFrame, path: str, fields: str = ",", enclosed: str = '"', header: bool = False) -> None:
    """A table or query as delimited text, a file for each partition."""
    df.write.option("sep", fields).option("quote", enclosed).option("header", header).option("emptyValue", f"{enclosed}{enclosed}").csv(path)


def export(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def create_as(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """CREATE TABLE AS, by partition directories. Rows are brought together by partition first, so each has few files."""
    dealt = df.repartition(*partition_by) if partition_by else df
    dealt.write.partitionBy(*partition_by).parquet(path)


def insert_into(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def interval_partition(df: DataFrame, column: str, unit: str = "MONTH", name: str = "part") -> DataFrame:
    """The partition key of INTERVAL partitions over a date: the start of its unit, as text that sorts."""
    return df.withColumn(name, F.date_format(F.date_trunc(unit, F.col(column)), "yyyy-MM-dd"))


def range_partition(df: DataFrame, column: str, bounds: Sequence[tuple[str, object]], name: str = "part") -> DataFrame:
    """The partition key of RANGE partitions: the first name whose upper bound lies above the value; None is MAXVALUE."""
    out = F.lit(None).cast("string")
    for label, bound in reversed(bounds):
        out = F.lit(label) if bound is None else F.when(F.col(column) < F.lit(bound), F.lit(label)).otherwise(out)
    return df.withColumn(name, out)


def list_partition(df: DataFrame, column: str, lists: Mapping[str, Sequence | None], name: str = "part") -> DataFrame:
    """The partition key of LIST partitions: the name whose list holds the value; None is DEFAULT. A value in none has no partition."""
    out = next((F.lit(label) for label, values in lists.items() if values is None), F.lit(None).cast("string"))
    for label, values in lists.items():
        if values is not None:
            out = F.when(F.col(column).isin(list(values)), F.lit(label)).otherwise(out)
    return df.withColumn(name, out)


def hash_partition(df: DataFrame, column: str, count: int, name: str = "part") -> DataFrame:
    """The partition key of HASH partitions, p0 to p(count - 1); the hash is Spark's."""
    return df.withColumn(name, F.concat(F.lit("p"), F.pmod(F.xxhash64(column), F.lit(count)).cast("string")))


def partition(spark: SparkSession, path: str, name: str, key: str = "part") -> DataFrame:
    """One partition, PARTITION (name): the filter is on the directory. Sub-partitions are a second key of create_as()."""
    return spark.read.parquet(path).filter(F.col(key) == name)


def partition_for(spark: SparkSession, path: str, value, bounds: Sequence[tuple[str, object]], key: str = "part") -> DataFrame:
    """PARTITION FOR (value): the RANGE partition that the value falls into; no rows if it falls into none."""
    label = next((name for name, bound in bounds if bound is None or value < bound), None)
    return partition(spark, path, label, key) if label is not None else spark.read.parquet(path).limit(0)


def remote(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of another database, as through a link."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def as_of(df: DataFrame, at, valid_from: str, valid_to: str | None = None) -> DataFrame:
    """A flashback query over rows that carry their validity: those that held at the moment."""
    out = df.filter(F.col(valid_from) <= F.lit(at))
    return out if valid_to is None else out.filter(F.col(valid_to).isNull() | (F.col(valid_to) > F.lit(at)))
