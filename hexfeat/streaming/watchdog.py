"""The watchdog's input as a stream: detections to scans.

Late data are bounded by a watermark, repeated polls by deduplication within it. Scans are event-time windows. What
follows from scans is in watch.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid


def detection_stream(spark: SparkSession, path: str, schema: str, late: str = "60 minutes", min_frp: float = 10.0) -> DataFrame:
    """Detections from Parquet files that arrive in a folder: old, weak and repeated ones are left out. seq names a detection, acq_ts is its time."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return rows.filter(F.coalesce("frp", F.lit(0.0)) >= min_frp).withWatermark("acq_ts", late).dropDuplicatesWithinWatermark(["seq"])


def scans(detections: DataFrame, level: int = 5, minutes: int = 360) -> DataFrame:
    """region, scan_ts, cells and max_frp of each scan window, once it is complete."""
    cell = grid.cell_of(F.col("latitude"), F.col("longitude"), level)
    window = F.window("acq_ts", f"{minutes} minutes")
    return detections.groupBy(window.alias("w"), "region").agg(F.collect_set(cell).alias("cells"), F.max("frp").alias("max_frp")).select("region", F.col("w.start").alias("scan_ts"), "cells", "max_frp")


def running_moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Streaming baseline: count, mean and deviation of each column by season, kept by the engine's own aggregation state."""
    long = rows.select("season", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("season", "x.*").filter("value is not null")
    return long.groupBy("feature", "season").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
