"""Payloads to rows: hourly weather JSON, period forecasts, field telemetry, synthetic terrain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

# Fixed value: required keys of a telemetry record and what they may hold.
TELEMETRY = "struct<source_type:string,priority:int,latitude:double,longitude:double,timestamp:string,confidence:double,frp:double,report_text:string,spatial_trust_radius_km:double>"
SOURCE_TYPES = ("field_telemetry", "drone", "ground_sensor")
HOURLY = ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation", "vapor_pressure_deficit")
PERIODS = 24


def hourly_weather(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row by cell and hour from JSON with parallel hourly arrays; short arrays pad with null, the index is always null, the flag 0."""
    fields = {"time": "string", **dict.fromkeys(HOURLY, "double")}
    schema = ", ".join(f"{c}:array<{t}>" for c, t in fields.items())
    parsed = df.withColumn("h", F.from_json(payload, f"struct<hourly:struct<{schema}>>")["hourly"])
    # An absent array is an empty one: arrays_zip of a null would be null.
    columns = [F.coalesce(F.col(f"h.{c}"), F.array().cast(f"array<{t}>")).alias(c) for c, t in fields.items()]
    zipped = parsed.select("grid_id", *columns).select("grid_id", F.explode(F.arrays_zip(*fields)).alias("x"))
    return zipped.select("grid_id", F.try_to_timestamp("x.time").cast("timestamp_ntz").alias("timestamp"), "x.temperature_2m", "x.relative_humidity_2m", "x.wind_speed_10m", "x.precipitation", F.col("x.vapor_pressure_deficit").alias("vpd"), F.lit(None).cast("double").alias("fire_weather_index"), F.lit(0).alias("data_quality_flag"))


def period_weather(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The first 24 forecast periods of each cell in metric units, flag 2; what such forecasts lack is null."""
    schema = "struct<periods:array<struct<startTime:string,temperature:double,humidity:double,windSpeed:string,windDirection:string>>>"
    periods = df.select("grid_id", F.posexplode(F.slice(F.from_json(payload, schema)["periods"], 1, PERIODS)).alias("at", "p"))
    return periods.select("grid_id", "at", F.try_to_timestamp("p.startTime").cast("timestamp_ntz").alias("timestamp"), scalar.celsius(F.col("p.temperature")).alias("temperature_2m"), F.col("p.humidity").alias("relative_humidity_2m"), scalar.mph_to_kmh(F.col("p.windSpeed")).alias("wind_speed_10m"), scalar.compass_degrees(F.col("p.windDirection")).alias("wind_direction_10m"), F.lit(None).cast("double").alias("precipitation"), F.lit(2).alias("data_quality_flag"))


def telemetry(df: DataFrame, payload: str = "payload", source_types: tuple[str, ...] = SOURCE_TYPES) -> DataFrame:
    """Parsed records with an array of issues; valid records are those without any."""
    t = F.from_json(payload, TELEMETRY, {"mode": "PERMISSIVE"})

    def issue(bad: Column, text: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(text))

    out = df.withColumn("t", t)
    keys = ("source_type", "priority", "latitude", "longitude", "timestamp", "confidence")
    given = {k: F.get_json_object(payload, f"$.{k}") for k in keys}
    issues = [issue(given[k].isNull(), f"missing {k}") for k in keys]
    issues += [issue(given[k].isNotNull() & F.col(f"t.{k}").isNull(), f"wrong type of {k}") for k in keys]
    issues += [issue(~F.col("t.source_type").isin(*source_types), "unknown source_type"), issue(~F.col("t.priority").between(1, 3), "priority out of range"), issue(~F.col("t.latitude").between(-90, 90), "latitude out of range"), issue(~F.col("t.longitude").between(-180, 180), "longitude out of range"), issue(~F.col("t.confidence").between(0, 100), "confidence out of range")]
    return out.withColumn("issues", F.array_compact(F.array(*issues)))


def ground_truth(df: DataFrame) -> DataFrame:
    """Valid telemetry as ground-truth rows."""
    return df.filter(F.size("issues") == 0).select("seq", "t.*").withColumns({"timestamp": F.try_to_timestamp("timestamp").cast("timestamp_ntz"), "fire_detected_binary": F.lit(1), "data_source_priority": F.col("priority"), "data_quality_flag": F.lit(0)})


def static_terrain(df: DataFrame) -> DataFrame:
    """Synthetic terrain of a cell from its position; fuel and vegetation are unknown."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.select("grid_id", F.bround(1000 * F.abs(F.sin(F.radians(lat))), 2).alias("elevation_m"), F.bround(30 * F.abs(F.cos(F.radians(lon))), 2).alias("slope_degrees"), F.bround(F.pmod(lon + 360, F.lit(360.0)), 2).alias("aspect_degrees"), F.lit(None).cast("smallint").alias("fuel_model_fbfm40"), F.lit(None).cast("smallint").alias("vegetation_type"), F.lit(0.0).alias("canopy_cover_pct"))
