"""The watchdog from end to end: detection files in, records out, one poll after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import grid, scalar
from ..operators import fill, records
from ..operators.gates import INDUSTRY_KM
from .watch import Rules, watch

EVERY = "30 minutes"


def hot_cells(sources: DataFrame, level: int, default_km: float = INDUSTRY_KM) -> DataFrame:
    """grid_id of the cells whose centre lies within radius_km of an industrial source (s_lat, s_lon, radius_km). Sources without a position are left out."""
    placed = sources.dropna(subset=["s_lat", "s_lon"]).select("s_lat", "s_lon", F.coalesce("radius_km", F.lit(default_km)).alias("km"))
    high = F.col("km") / grid.KM_PER_DEGREE * 1.01
    wide = high / F.greatest(F.cos(F.radians(F.least(F.abs("s_lat") + high, F.lit(89.0)))), F.lit(0.01))
    rings = placed.withColumn("ring", fill.box(F.col("s_lon") - wide, F.col("s_lat") - high, F.col("s_lon") + wide, F.col("s_lat") + high))
    near = fill.polygon_cells(rings, ["s_lat", "s_lon", "km"], level)
    return near.filter(scalar.haversine_km(F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon")) <= F.col("km")).select("grid_id").distinct()


def polled_scans(detections: DataFrame, hot: DataFrame | None, level: int, minutes: int, confirms: str, min_frp: float = 1.0) -> DataFrame:
    """Scans of a stream of detections that has a watermark on acq_ts: for each region and stretch of time what `watch` takes.

    confirms tells the detections of the confirming feed (an SQL condition); of these, those of at least min_frp count.
    """
    placed = detections.withColumn("grid_id", grid.cell_of(F.col("latitude"), F.col("longitude"), level)).withColumn("confirms", F.coalesce(F.expr(confirms), F.lit(False)))
    placed = placed.withColumn("hot", F.lit(False)) if hot is None else placed.join(hot.withColumn("hot", F.lit(True)), "grid_id", "left")
    set_of = lambda which: F.collect_set(F.when(which, F.col("grid_id")))
    own = ~F.col("confirms")
    found = placed.groupBy("region", F.window("acq_ts", f"{minutes} minutes").alias("w")).agg(
        set_of(own).alias("cells"), F.max(F.when(own, F.col("frp"))).alias("max_frp"), set_of(F.col("confirms") & (F.col("frp") >= min_frp)).alias("reference"), set_of(own & F.coalesce("hot", F.lit(False))).alias("hot"),
    )
    return found.select("region", F.col("w.start").alias("scan_ts"), "cells", "max_frp", "reference", "hot")


def serve(detections: DataFrame, sources: DataFrame | None, out: str, checkpoint: str, level: int = 5, minutes: int = 30, confirms: str = "false", rules: Rules = Rules(clock="ProcessingTime"), **trigger) -> StreamingQuery:
    """Starts the watch over a stream of detections (see watchdog.detection_stream): each poll (every 30 minutes, or as
    trigger says) takes the new detections, and triggers, false alarms and emergencies are written under out. Timers run
    by the clock, so a false alarm is taken back by a later poll without any detection."""
    hot = None if sources is None else hot_cells(sources, level)
    told = watch(polled_scans(detections, hot, level, minutes, confirms), rules, None)
    return told.writeStream.foreachBatch(records.write_records(out)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": EVERY})).start()
