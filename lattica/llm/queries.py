"""One query for each operator, over the whole of its table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, chunk_dedup, exact_dedup, fingerprint, html_extract, langid, packing, pii, simhash, toxicity
from lattica.llm.common import fold, table



def vocabulary_path() -> str:
    """The tokenizer's file: LATTICA_BPE_FILE, or the installed public one."""
    if named := os.environ.get("LATTICA_BPE_FILE"):
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels.filter(fold("doc_id", 3) != 1)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunk_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.coalesce("repeats", F.expr("array()"))
    size = F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"])
    cut = F.aggregate(F.filter(spans, lambda s: ~s["first"]), F.lit(0), lambda a, s: a + s["end"] - s["start"])
    listed = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return docs.select("doc_id", size.alias("repeated_chars"), cut.alias("removed_chars"), listed.alias("repeat_spans"), "text")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2))
    return langid.predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), packing.word_count())


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {q.__name__: q for q in (op1_toxicity, op2_simhash, op3_pii, op4_bpe, op5_chunk_dedup, op6_html, op7_langid, op8_exact_dedup, op9_packing, op10_fingerprint, pipeline)}

ORACLES = {
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
        FROM d JOIN g USING (text_sha256)""",
}
