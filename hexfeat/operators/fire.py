"""Fire features of grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from . import near


def aggregate_fire(df: DataFrame, keys: list[str]) -> DataFrame:
    """Detections counted and summarised by key: count, mean and median frp, highest confidence, and the label 1."""
    return df.groupBy(*keys).agg(
        F.count("latitude").cast("int").alias("active_fire_count"), F.coalesce(F.avg("frp"), F.lit(0.0)).alias("mean_frp"), F.coalesce(F.median("frp"), F.lit(0.0)).alias("median_frp"),
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("max_confidence"), F.lit(1).alias("fire_detected_binary"),
    )


def nearest_fire(cells: DataFrame, scope: list[str], res_km: float) -> DataFrame:
    """nearest_fire_distance_km: steps to the nearest other fire cell of the scope times 0.75 res_km; -1 without any.

    cells: scope, q, r (one row for each cell of a scope). A step changes neither coordinate by more than one, so squares
    of axial coordinates bound the distance from below. Cells of a square that are still open after a round lie at least
    that far from each other, so no square is asked by many.
    """
    asked = cells.select(*scope, F.col("q").alias("x"), F.col("r").alias("y"))
    nodes = cells.select(*scope, F.col("q").alias("nx"), F.col("r").alias("ny"), F.struct("q", "r").alias("node"))
    steps = grid.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    told = near.nearest(asked, nodes, [*scope, "x", "y"], scope, steps, lambda side: side + 1, 4.0, steps > 0)
    km = told.select(*scope, F.col("x").alias("q"), F.col("y").alias("r"), F.coalesce(F.col("gap") * (res_km * 0.75), F.lit(-1.0)).alias("nearest_fire_distance_km"))
    return cells.join(km, [*scope, "q", "r"])
