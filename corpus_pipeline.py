"""The corpus pipeline: toxicity, exact dedup, n-gram join, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; its result is written as Parquet
and read again as the next stage's docs. All stages but the last return the columns of docs, extra ones included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexfeat.llm import common, exact_dedup, ngram_join, packing, secrets, toxicity


def _only(docs: DataFrame, chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of docs that chosen picks from rows (doc_id, text): there, doc_id is a key of each row's own."""
    rows, key = common.keyed(docs)
    ids = chosen(rows.select(F.col(key).alias("doc_id"), "text"))
    return rows.join(ids.select(F.col("doc_id").alias(key)), key, "left_semi").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; null and empty texts stay."""
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scores("text", model) < toxicity.TOXIC_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the one with the smallest doc_id, none being the largest."""
    return _only(docs, lambda rows: exact_dedup.exact_dedup(rows).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near copies, none being the largest."""
    return _only(docs, lambda rows: ngram_join.jaccard_join(rows).filter("doc_id = component_id"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked; n_chars, where there is one, follows the text."""
    columns = docs.columns
    out = docs.withColumn("text", secrets.without_secrets("text"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.harmonic_pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("secret_scans", mask_secrets), ("packing", pack)]

#: SQL has no tokenizer and no trained model; tests/llm tests its stages one by one; there is no brute-force version of the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = common.read(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, common.stored(docs) if at else docs, sf_dir)
    return docs
