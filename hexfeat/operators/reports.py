"""Backfill calendars, training manifests, incident context, trigger order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_FIRE_DAYS, MIN_FIRE_CELLS, MIN_OK = 50, 30, 0.80
#: Order in which triggers are taken; other modes come last.
TRIGGER_ORDER = {"emergency": 0, "active": 1}


def backfill_calendar(spark: SparkSession, start: str, end: str, hours: int = 6) -> DataFrame:
    """window_ts from start to end, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.make_dt_interval(hours=F.lit(hours)))).alias("window_ts"))


def calendar_of(rows: DataFrame, time: str, hours: int = 6) -> DataFrame:
    """window_ts from the first to the last time of rows, both included; no rows give no windows."""
    ends = rows.agg(F.min(time).alias("first"), F.max(time).alias("last")).filter("first is not null")
    return ends.select(F.explode(F.sequence("first", "last", F.make_dt_interval(hours=F.lit(hours)))).alias("window_ts"))


def backfill_pending(calendar: DataFrame, written: DataFrame) -> DataFrame:
    """Windows of the calendar that are not written yet."""
    return calendar.join(written.select("window_ts").distinct(), "window_ts", "left_anti")


def region_manifest(fused: DataFrame) -> DataFrame:
    """Rows, fire days, fire cells and share of good flags of each region, and whether that is enough for training."""
    fire = F.col("fire_detected_binary") == 1
    out = fused.groupBy("region").agg(F.count("*").alias("row_count"), F.count_distinct(F.when(fire, F.col("date"))).alias("fire_event_days"), F.count_distinct(F.when(fire, F.col("grid_id"))).alias("unique_fire_cells"), F.avg((F.col("data_quality_flag") <= 2).cast("double")).alias("ok"))
    enough = (F.col("fire_event_days") >= MIN_FIRE_DAYS) & (F.col("unique_fire_cells") >= MIN_FIRE_CELLS) & (F.col("ok") >= MIN_OK)
    return out.select("region", "row_count", "fire_event_days", "unique_fire_cells", F.round("ok", 3).alias("quality_flag_ok_pct"), enough.alias("sufficient_for_training"))


def report_context(fused: DataFrame, order: list[str]) -> DataFrame:
    """One row: weather of the last row in order, fires in total, largest mean frp, mean slope and canopy."""
    weather = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "vpd"]
    last = F.max_by(F.struct(*weather), F.struct(*order))
    return fused.agg(last.alias("w"), F.sum("active_fire_count").alias("active_fire_cells"), F.max("mean_frp").alias("max_frp_mw"), F.avg("slope_degrees").alias("average_slope_degrees"), F.avg("canopy_cover_pct").alias("canopy_cover_pct")).select(*[F.col(f"w.{c}").alias(c) for c in weather], "active_fire_cells", "max_frp_mw", "average_slope_degrees", "canopy_cover_pct")


def context_text(context: DataFrame) -> DataFrame:
    """The context as a block of text for a report writer."""
    return context.select(F.format_string("Weather: %.1f C, %.0f %% humidity, wind %.1f km/h, VPD %.2f kPa\nFires: %d detections, largest mean FRP %.1f MW\nTerrain: slope %.1f degrees, canopy %.1f %%", "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "vpd", "active_fire_cells", "max_frp_mw", "average_slope_degrees", "canopy_cover_pct").alias("context"))


def next_trigger(triggers: DataFrame) -> DataFrame:
    """The trigger to take next: emergencies, then active ones, then the rest; the oldest name first."""
    rank = F.coalesce(*[F.when(F.col("mode") == m, r) for m, r in TRIGGER_ORDER.items()], F.lit(99))
    return triggers.withColumn("priority", rank).orderBy("priority", "name").limit(1)


def mode_parameters(modes: DataFrame, config: dict[str, dict]) -> DataFrame:
    """Pipeline parameters of each row's mode; an unknown mode counts as quiet."""
    known = F.when(F.col("mode").isin(*config), F.col("mode")).otherwise("quiet")
    pick = lambda key: F.coalesce(*[F.when(known == m, F.lit(v.get(key))) for m, v in config.items()])
    return modes.select("*", pick("resolution_km").alias("resolution_km"), pick("lookback_hours").alias("lookback_hours"))
