"""A corpus pipeline of five stages: toxicity, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes it as Parquet and reads it again
for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import exact_dedup, packing, pii, simhash, toxicity
from lattica.llm.common import fold, materialised, table
from lattica.sources import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The model learns from the labels outside of the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    columns = docs.columns
    scored = toxicity.score(docs.withColumn("_doc", F.struct(*columns)), model, passed=("_doc",))
    return scored.filter("predicted = 0").select("_doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, null as empty, the one with the largest id stays; of equal rows, one."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that pairs of 0.8 or more in Jaccard similarity of five-word shingles connect, the one with the least id
    stays, and all without an id. Candidates come from blocks of SimHashes."""
    return simhash.drop_near(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become tags; n_chars follows the text. Null and empty texts stay as they are; the whole of long ones is read."""
    text = pii.redact("text")
    return docs.withColumn("text", text).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its bin; documents without words have one row and no bin."""
    return packing.best_fit(docs, packing.word_count())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: Learnt scores and best-fit packing have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's output stays only until the next one is written, and its scratch tables go with it."""
    docs, start = table(spark, sf_dir, "documents"), scratch.mark()
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.clear_since(spark, start)
    return docs
