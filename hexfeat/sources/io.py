"""Readers and writers around the pipeline: typed CSV and Parquet in, partitioned Parquet, JSON records and arrays out."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators.reports import backfill_pending

# Fixed columns of a raw detection file.
DETECTION_COLUMNS = "latitude double, longitude double, brightness double, scan double, track double, acq_date string, acq_time string, satellite string, instrument string, confidence string, version string, bright_t31 double, frp double, daynight string"
WEATHER_COLUMNS = "grid_id string, timestamp timestamp_ntz, temperature_2m double, relative_humidity_2m double, wind_speed_10m double, wind_direction_10m double, precipitation double, soil_moisture_0_to_7cm double, vpd double, fire_weather_index double, data_quality_flag int"


def read_detections(spark: SparkSession, paths: dict[tuple[str, str], str]) -> DataFrame:
    """CSV files by (region, sensor), tagged and united; detections of several sensors are all kept. Malformed numbers are null; no file gives an empty table with all columns."""
    schema = f"{DETECTION_COLUMNS}, region string, sensor_source string"
    out = spark.createDataFrame([], schema)
    for (region, sensor), path in paths.items():
        part = spark.read.schema(DETECTION_COLUMNS).option("header", True).option("mode", "PERMISSIVE").csv(path)
        out = out.unionByName(part.withColumns({"region": F.lit(region), "sensor_source": F.lit(sensor)}))
    return out.withColumn("acq_ts", scalar.acquisition_time(F.col("acq_date"), F.col("acq_time")))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEATHER_COLUMNS).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned feature table; filters on region, year and month prune folders."""
    return spark.read.parquet(path)


def read_records(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """JSON records, one or several a file; malformed ones are left out, absent fields take defaults."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.filter("_corrupt is null").drop("_corrupt")
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (defaults or {}).items()})


def export_features(df: DataFrame, path: str, window: str = "window_ts") -> None:
    """Partitions by region, year and month; only partitions that df has are replaced.

    Rows are rebalanced by partition, so that small ones hold one file and adaptive execution splits large ones over tasks.
    """
    out = df.withColumns({"date": F.to_date(window), "year": F.year(window), "month": F.month(window), "region": F.coalesce("region", F.lit("unknown"))})
    out.hint("rebalance", "region", "year", "month").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("region", "year", "month").parquet(path)


def write_windows(df: DataFrame, calendar: DataFrame, written: DataFrame | None, path: str) -> DataFrame:
    """Writes the calendar's windows that are not written yet, all in one job; returns them.

    Each window is a partition of its own and is replaced as a whole, so a job that runs again after a failure leaves no
    row twice.
    """
    todo = calendar if written is None else backfill_pending(calendar, written)
    out = df.join(F.broadcast(todo), "window_ts", "left_semi")  # four windows a day
    keys = ["year", "month", "window"]
    dealt = out.withColumns({"year": F.year("window_ts"), "month": F.month("window_ts"), "window": F.date_format("window_ts", "yyyyMMddHHmmss")}).hint("rebalance", *keys)
    dealt.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*keys).parquet(path)
    return todo


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_state_batch(path: str):
    """A foreachBatch function that writes each micro-batch to a folder of its own number: a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return write


def backoff_seconds(first: float, most: float, failures: int, seed: int = 0) -> Iterator[float]:
    """Waits between attempts of a connector: doubling up to `most`, times a factor of 0.5 to 1.5."""
    spread = random.Random(seed)
    for k in range(failures):
        yield min(first * 2**k, most) * spread.uniform(0.5, 1.5)
