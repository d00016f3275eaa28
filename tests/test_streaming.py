"""Windows over streams give what they give over the same rows as a batch."""

from pyspark.sql import functions as F

from lattica.sources.tables import load
from lattica.streaming import windows

SF_DIR = "/root/testdata/sf0.001"


def drained(df, name, mode="complete"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_windows(spark, tmp_path):
    batch = load(spark, SF_DIR, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))
    n = {"n": F.count(F.lit(1)), "top": F.max("value")}
    assert rows(drained(windows.tumbling(stream, "ts", "1 hour", "event_type", **n), "tumbling_out")) == rows(windows.tumbling(batch, "ts", "1 hour", "event_type", **n))
    assert rows(drained(windows.sliding(stream, "ts", "1 hour", "20 minutes", late="1 day", **n), "sliding_out")) == rows(windows.sliding(batch, "ts", "1 hour", "20 minutes", **n))
    assert rows(drained(windows.sessions(stream, "ts", "30 minutes", "user_id", **n), "sessions_out")) == rows(windows.sessions(batch, "ts", "30 minutes", "user_id", **n))


def test_builders_over_streams(spark, tmp_path):
    from lattica.functions import compat, dates

    batch = load(spark, SF_DIR, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))

    def made(df):
        return df.select("event_id", dates.to_char(F.col("ts"), "YYYY Q").alias("q"), compat.cat(F.col("event_type"), F.lit(None)).alias("t"))

    assert rows(drained(made(stream), "made_out", "append")) == rows(made(batch))
