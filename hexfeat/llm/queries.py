"""One query for each operator of this subpackage, over the whole documents table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, filter_audit, importance, licenses, ngram_join, packing, quality_classifier, quality_rules, secrets, sharding, topk, toxicity, tree_bpe
from .common import read


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.score_quality(docs, quality_classifier.fit(docs))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"), licenses.fit(spark))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op4_harmonic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(read(spark, sf_dir, "documents"))


def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.encode_decode(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(read(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op11_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_license_scans": op2_license_scans,
    "op3_quality_rules": op3_quality_rules,
    "op4_harmonic_pack": op4_harmonic_pack,
    "op5_tree_bpe": op5_tree_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_secret_scans": op10_secret_scans,
    "op11_importance_sample": op11_importance_sample,
    "op12_exact_topk": op12_exact_topk,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_importance_sample": importance.ORACLE_SQL,
    "op12_exact_topk": topk.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
