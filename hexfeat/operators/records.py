"""Records of the watchdog, typed: pipeline triggers, false alarms, beginnings and ends of emergencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The resolution that a mode asks for, and the range around fire cells.
RESOLUTIONS = {"quiet": 64, "active": 64, "emergency": 22}
RANGE_KM, RINGS = 25, 5


def record_id(kind: str, *columns: str) -> Column:
    """An id that follows from what is recorded, so that a batch that is run again gives the same records."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 32)


def _resolution(mode: Column) -> Column:
    """Of an unknown mode that of quiet."""
    return F.coalesce(*[F.when(mode == m, km) for m, km in RESOLUTIONS.items()], F.lit(RESOLUTIONS["quiet"]))


def trigger_records(told: DataFrame) -> DataFrame:
    """A pipeline trigger for each confirmed scan (region, at, confirmed, fire_cells, max_frp, mode)."""
    fires = told.filter("kind = 'scan' and confirmed")
    mode = F.coalesce("mode", F.lit("quiet"))
    return fires.select(
        record_id("trigger", "region", "at").alias("trigger_id"), F.col("at").alias("triggered_at"), F.concat(F.lit("watchdog_"), mode).alias("trigger_source"), _resolution(mode).alias("resolution_km"),
        F.array("region").alias("regions"), F.array_sort("fire_cells").alias("fire_cells"), F.col("max_frp").alias("fire_frp_mw"), mode.alias("mode"), F.lit(RANGE_KM).alias("detection_range_km"), F.lit(RINGS).alias("h3_ring_max"),
    )


def false_alarm_records(told: DataFrame) -> DataFrame:
    """A record for each scan with detections that a gate has stopped."""
    stopped = told.filter("kind = 'scan' and not confirmed and n_candidates > 0")
    summary = F.struct(F.col("n_candidates").alias("candidate_cells"), "n_spatial", "n_persistent", "max_frp")
    return stopped.select(record_id("false_alarm", "region", "at").alias("id"), F.col("at").alias("recorded_at"), "region", "gate_failed", summary.alias("summary"))


def emergency_records(told: DataFrame) -> DataFrame:
    """A record for each beginning and end of an emergency."""
    return told.filter("event is not null").select(record_id("emergency", "region", "at", "event").alias("id"), "event", F.col("at").alias("timestamp"), F.struct("region", "fire_cells", F.col("max_frp").alias("frp_mw"), "mode").alias("details"))


KINDS = {"triggers": trigger_records, "false_alarms": false_alarm_records, "emergency": emergency_records}


def write_records(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over what `watch` tells: each kind has a folder, each micro-batch replaces its own part of it."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for kind, records in KINDS.items():
                records(rows).write.mode("overwrite").json(f"{path}/{kind}/batch={number}")
        finally:
            rows.unpersist()

    return write
