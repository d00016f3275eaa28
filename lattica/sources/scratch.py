"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}
_thread = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode, as in tests, and an error on a cluster."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if context.applicationId not in _temporary:
        _temporary[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _temporary[context.applicationId]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lattica/{spark.sparkContext.applicationId}"


def _made() -> list[str]:
    if not hasattr(_thread, "made"):
        _thread.made = []
    return _thread.made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path there that nothing has used yet, in a folder of the application's own."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made().append(path)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: the plan starts anew there and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def mark() -> int:
    """Where this thread's list of scratch tables stands, for clear_since()."""
    return len(_made())


def clear_since(spark: SparkSession, since: int) -> None:
    """Delete the tables that this thread wrote since the mark, but for the last one."""
    made = _made()
    for path in made[since:-1]:
        _delete(spark, path)
    del made[since:-1]


def clear_scratch(spark: SparkSession) -> None:
    """Delete what the application wrote there. Call it once no result that was built on it is needed any more."""
    _delete(spark, _folder(spark))
