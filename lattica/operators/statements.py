"""Statements beside queries: tables, views, synonyms, sequences, statistics, session settings, hints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.ordering import with_rownum

#: The dialect's type names.
TYPES = {
    "TINYINT": "tinyint", "UTINYINT": "smallint", "SMALLINT": "smallint", "SHORT": "smallint", "USMALLINT": "int", "USHORT": "int", "INT": "int", "INTEGER": "int", "BINARY_INTEGER": "int", "UINT": "bigint",
    "UINTEGER": "bigint", "BINARY_UINT32": "bigint", "BIGINT": "bigint", "BINARY_BIGINT": "bigint", "SERIAL": "bigint", "UBIGINT": "decimal(20,0)", "FLOAT": "double", "REAL": "double", "DOUBLE": "double",
    "BINARY_DOUBLE": "double", "NUMBER": "decimal(38,10)", "NUMBER2": "decimal(38,10)", "DECIMAL": "decimal(38,10)", "NUMERIC": "decimal(38,10)", "CHAR": "string", "BPCHAR": "string", "NCHAR": "string", "VARCHAR": "string",
    "VARCHAR2": "string", "NVARCHAR": "string", "NVARCHAR2": "string", "CLOB": "string", "TEXT": "string", "LONGTEXT": "string", "LONG": "string", "BINARY": "binary", "VARBINARY": "binary", "RAW": "binary", "BLOB": "binary",
    "BYTEA": "binary", "IMAGE": "binary", "LONGBLOB": "binary", "MEDIUMBLOB": "binary", "JSONB": "string", "BOOL": "boolean", "BOOLEAN": "boolean", "DATE": "timestamp_ntz", "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz",
    "TIMESTAMP WITH LOCAL TIME ZONE": "timestamp", "TIMESTAMP WITH TIME ZONE": "struct<ts:timestamp,tz:string>", "INTERVAL YEAR TO MONTH": "interval year to month", "INTERVAL DAY TO SECOND": "interval day to second",
}


def spark_type(name: str) -> str:
    """The Spark type for a type name of the dialect, NUMBER(8,2) and arrays such as INT[] included."""
    text = " ".join(name.upper().split())
    if text.endswith("[]"):
        return f"array<{spark_type(text[:-2])}>"
    base, _, rest = text.partition("(")
    args, _, tail = rest.partition(")")
    key = f"{base.strip()} {tail.strip()}".strip()
    if key in ("NUMBER", "NUMBER2", "DECIMAL", "NUMERIC") and args:
        precision, _, scale = args.partition(",")
        return f"decimal({int(precision)},{max(0, int(scale or 0))})"
    return TYPES[key]


def create_table(spark: SparkSession, name: str, columns: Mapping[str, str], partition_by: Sequence[str] = (), location: str | None = None) -> DataFrame:
    """CREATE TABLE with the dialect's types, as Parquet."""
    listed = ", ".join(f"`{c}` {spark_type(t)}" for c, t in columns.items())
    parts = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE `{name}` ({listed}) USING parquet{parts}{where}")
    return spark.table(name)


def truncate_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE `{name}`")


def drop_table(spark: SparkSession, name: str, if_exists: bool = False) -> None:
    spark.sql(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}`{name}`")


def create_view(df: DataFrame, name: str) -> None:
    """CREATE OR REPLACE VIEW for the session; a temporary table is the same with a materialised df."""
    df.createOrReplaceTempView(name)


def synonym(spark: SparkSession, name: str, of: str) -> None:
    spark.table(of).createOrReplaceTempView(name)


def analyze(spark: SparkSession, name: str, *columns: str) -> None:
    """Statistics for the cost-based optimizer."""
    what = f"FOR COLUMNS {', '.join(columns)}" if columns else "FOR ALL COLUMNS"
    spark.sql(f"ANALYZE TABLE `{name}` COMPUTE STATISTICS {what}")


def numbered(df: DataFrame, *by: str, start: int = 1, step: int = 1, name: str = "nextval") -> DataFrame:
    """NEXTVAL of a sequence for each row, in an order: distinct and without gaps within the statement."""
    return with_rownum(df, *by, name="_nth").withColumn(name, F.lit(start) + (F.col("_nth") - 1) * step).drop("_nth")


#: Session settings of the dialect and what they set.
SETTINGS = {"TIME_ZONE": "spark.sql.session.timeZone", "NLS_CALENDAR": None, "PARALLEL": "spark.sql.shuffle.partitions", "ENABLE_NESTLOOP_JOIN": None, "EMPTY_STRING_AS_NULL": None}


def alter_session(spark: SparkSession, name: str, value: object) -> bool:
    """ALTER SESSION SET; False if the setting says nothing to Spark. For EMPTY_STRING_AS_NULL use nulls_for_empty() on the tables read."""
    key = SETTINGS[name.upper()]
    if key:
        spark.conf.set(key, str(value))
    return key is not None


#: Optimizer hints that say something to Spark; all others are accepted and ignored.
HINTS = {"USE_HASH": "shuffle_hash", "USE_MERGE": "merge", "USE_NL": "shuffle_replicate_nl", "HASH_TABLE": "broadcast", "NL_FULL_MTRL": "broadcast", "PARALLEL": "repartition"}
IGNORED = frozenset(
    "FULL INDEX NO_INDEX INDEX_ASC INDEX_DESC INDEX_FFS INDEX_SS NO_INDEX_FFS NO_INDEX_SS USE_CONCAT ROWID LEADING ORDERED NL_FULL_OPT NO_HASH_TABLE NL_BATCH HASH_AJ HASH_SJ UNNEST NO_UNNEST SEMI_TO_INNER NO_PUSH_PRED OR_EXPAND NO_OR_EXPAND INLINE CB_MTRL NO_CB_MTRL RULE HASH_BUCKET_SIZE THROW_DUPLICATE OPT_PARAM OPT_ESTIMATE DB_VERSION FEATURES_ENABLE OPTIM_MODE".split()
)


def hint(df: DataFrame, name: str, *args: object) -> DataFrame:
    key = name.upper()
    if key == "MATERIALIZE":
        from lattica.sources.scratch import materialised

        return materialised(df, "with")
    if key in HINTS:
        return df.hint(HINTS[key], *args)
    if key in IGNORED:
        return df
    raise ValueError(f"{name} isn't a hint")
