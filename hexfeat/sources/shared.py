"""Tables that end a lineage: written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master, where all share a machine, gets a folder of its own if there is none."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="hexfeat-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, kind: str = "tables") -> str:
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again, so that a lost executor costs no recomputation of what came before."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
