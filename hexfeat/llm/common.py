"""What the operators share: input columns, word patterns, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but the six ASCII blanks; bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns of the input can have any name; a null text becomes the empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keyed(docs: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """columns of docs (all of them if None) with a key of each row's own, and the key's name.

    doc_id is the key if no row lacks or shares one. If any does, the rows are written once with a new column that
    follows the order of doc_id, rows without one last; equal ids are ordered by the hash of their texts.
    """
    columns = columns or docs.columns
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("of")).filter("of > 1 or doc_id is null")
    if dict(docs.dtypes)["doc_id"] == "bigint" and shared.isEmpty():
        return docs.select(*columns), "doc_id"
    name = "row_key"
    while name in docs.columns:
        name += "_"
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    dealt = docs.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.withColumn(name, F.monotonically_increasing_id())), name


def picked(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` of the rows (doc_id, text, and others that follow from these), with their hash as `pick`.

    Rows are chosen by the hash of id and text, the lowest first, whatever the number of rows; a null id counts as none.
    Rows that share both are one. The texts themselves are not sorted: the bound on the hash is found first.
    """
    hashed = rows.withColumn("pick", F.xxhash64("doc_id", "text"))
    bound = hashed.select("pick").distinct().orderBy("pick").limit(most).agg(F.max("pick")).first()[0]
    return hashed.filter(F.col("pick") <= F.lit(bound)).dropDuplicates(["pick"]) if bound is not None else hashed.limit(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local master gets one of its own."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="hexfeat-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
