"""Fusion: one row for each cell and window, from the grid and what is known about its cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import Registry

#: Fixed values of the data model: the fire columns of a cell without detections.
FIRE_DEFAULTS = {"active_fire_count": 0, "mean_frp": 0.0, "median_frp": 0.0, "max_confidence": 0.0, "nearest_fire_distance_km": -1.0, "fire_detected_binary": 0}
#: Fixed values of the data model: columns that the quality flag does not count.
UNCOUNTED = ("grid_id", "latitude", "longitude", "timestamp", "resolution_km", "data_quality_flag")
SPARSE_FROM, SPARSE_FLAG = 0.3, 3


def safe_left_join(left: DataFrame, right: DataFrame | None, keys: list[str], small: bool = False) -> DataFrame:
    """Left join that takes columns of both names from the left; a missing right side or key changes nothing.

    small: the right side is a dimension whose size the caller has checked, so it may be broadcast.
    """
    if right is None or any(k not in right.columns for k in keys):
        return left
    right = right.select(*keys, *[c for c in right.columns if c not in left.columns])
    return left.join(F.broadcast(right) if small else right, keys, "left")


def fire_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) if c in df.columns else F.lit(v) for c, v in FIRE_DEFAULTS.items()})


def quality_flag(df: DataFrame) -> DataFrame:
    """data_quality_flag 3 where 30 % or more of the counted columns are null, else 0."""
    counted = [c for c in df.columns if c not in UNCOUNTED]
    nulls = sum((F.col(c).isNull().cast("int") for c in counted), F.lit(0))
    return df.withColumn("data_quality_flag", F.when(nulls / max(1, len(counted)) >= SPARSE_FROM, SPARSE_FLAG).otherwise(0))


def fuse_features(panel: DataFrame, fire: DataFrame | None, weather: DataFrame | None, static: DataFrame | None, registry: Registry, keys: list[str] | None = None) -> DataFrame:
    """panel (cells x windows, with region) left-joined with fire, weather and static features; filled, flagged and put in order.

    Right sides are unique by key. Fire and weather join on cell and window, static on the cell alone.
    """
    keys = keys or ["grid_id", "window_ts"]
    out = safe_left_join(panel, fire, keys)
    out = fire_defaults(out)
    out = safe_left_join(out, weather, keys)
    out = safe_left_join(out, static, ["grid_id"])
    out = registry.filled(out)
    return registry.arranged(quality_flag(out))


def temporal_lag(current: DataFrame, previous: DataFrame | None, registry: Registry, keys: list[str], step, strict: bool = False) -> DataFrame:
    """Fire context of the window before (key window_ts = window_ts - step), the label as it is.

    Columns that previous lacks keep the current values, or take their defaults if strict; cells without a previous
    row take the defaults. This is a self-join, not lag(): windows may be missing.
    """
    lagged = [c for c in registry.lagged() if c in current.columns]
    have = [c for c in lagged if previous is not None and c in previous.columns]
    out = current
    if previous is not None:
        before = previous.select(*[k for k in keys if k != "window_ts"], (F.col("window_ts") + step).alias("window_ts"), *[F.col(c).alias(f"_before_{c}") for c in have])
        out = current.join(before, keys, "left")
    default = {c: F.lit(FIRE_DEFAULTS[c]) for c in lagged}
    moved = {c: F.coalesce(f"_before_{c}", default[c]) if c in have else (default[c] if strict or previous is None else F.col(c)) for c in lagged}
    rest = [c for c in current.columns if c not in lagged]
    return out.select(*rest, *[v.alias(c) for c, v in moved.items()])


def temporal_lag_window(panel: DataFrame, columns: list[str]) -> DataFrame:
    """The same by lag(), for a panel that has every window of every cell."""
    w = Window.partitionBy("grid_id").orderBy("window_ts")
    return panel.withColumns({c: F.coalesce(F.lag(c, 1).over(w), F.lit(FIRE_DEFAULTS[c])) for c in columns})
