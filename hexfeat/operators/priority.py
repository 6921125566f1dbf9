"""Source priority: ground truth overrides satellite values near it in space and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns that ground truth replaces.
OVERRIDDEN = ("active_fire_count", "mean_frp", "median_frp", "max_confidence", "fire_detected_binary")
GROUND_TRUTH, SATELLITE = 1, 2


def no_override(fused: DataFrame) -> DataFrame:
    """Without ground truth, rows only get the satellite's priority."""
    return fused if "data_source_priority" in fused.columns else fused.withColumn("data_source_priority", F.lit(SATELLITE))


def priority_override(fused: DataFrame, truth: DataFrame | None, radius_km: float = 5.0, hours: int = 6, keys: tuple[str, ...] = ("grid_id", "window_ts")) -> DataFrame:
    """Each value of OVERRIDDEN from the last (by seq) ground truth row with one, within radius_km and hours of the cell.

    The ball is planar in degrees (111 km each). Both sides are dealt to squares of that size and to stretches of time of
    `hours`, the truth to the nine squares and three stretches around it, so both range conditions become an equi-join
    with an exact filter, and a window only meets the truth of its own time; one aggregate then picks the last non-null
    value of each column. Truth without a position or time is not used.
    """
    if truth is None:
        return no_override(fused)
    delta = radius_km / 111.0
    square = lambda c: F.floor(F.col(c) / delta).cast("long")
    stretch = lambda c: F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c)) / (hours * 3600)).cast("long")
    cells = fused.select(*keys, "latitude", "longitude").withColumns({"_y": square("latitude"), "_x": square("longitude"), "_t": stretch("window_ts")})
    around = F.array(*[F.struct((square("lat") + dy).alias("y"), (square("lon") + dx).alias("x"), (stretch("timestamp") + dt).alias("t")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) for dt in (-1, 0, 1)])
    values = [c for c in OVERRIDDEN if c in truth.columns]
    told = truth.dropna(subset=["latitude", "longitude", "timestamp"]).select("seq", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "timestamp", *[F.col(c).alias(f"_t_{c}") for c in values])
    told = told.withColumn("_s", F.explode(around)).select("*", F.col("_s.y").alias("_y"), F.col("_s.x").alias("_x"), F.col("_s.t").alias("_t")).drop("_s")
    near = cells.join(told, ["_y", "_x", "_t"]).filter(
        (F.sqrt(F.pow(F.col("latitude") - F.col("lat"), 2) + F.pow(F.col("longitude") - F.col("lon"), 2)) <= delta)
        & (F.abs(F.timestamp_diff("SECOND", F.col("timestamp"), F.col("window_ts"))) <= hours * 3600)
    )
    last = near.groupBy(*keys).agg(*[F.max_by(f"_t_{c}", F.when(F.col(f"_t_{c}").isNotNull(), F.col("seq"))).alias(f"_t_{c}") for c in values], F.lit(True).alias("_told"))
    out = no_override(fused).join(last, list(keys), "left")
    changed = {c: F.coalesce(F.col(f"_t_{c}").cast(dict(fused.dtypes)[c]), F.col(c)) for c in values if c in fused.columns}
    return out.withColumns(changed | {"data_source_priority": F.when(F.col("_told"), GROUND_TRUTH).otherwise(F.col("data_source_priority"))}).select(*fused.columns, *([] if "data_source_priority" in fused.columns else ["data_source_priority"]))
