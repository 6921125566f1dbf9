"""Raster and graph exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raster_index(df: DataFrame, res_km: float, scope: list[str] | None = None) -> DataFrame:
    """row and col of each cell on a raster whose origin is the smallest latitude and longitude of the scope."""
    scope = scope or []
    origin = df.groupBy(*scope).agg(F.min("latitude").alias("_lat0"), F.min("longitude").alias("_lon0"), F.avg("latitude").alias("_mean"))
    joined = df.join(origin, scope) if scope else df.crossJoin(F.broadcast(origin))  # one row
    lat_step = F.lit(res_km / 111.0)
    lon_step = F.lit(res_km) / (111.0 * F.cos(F.radians("_mean")))
    return joined.withColumns({"row": F.floor((F.col("latitude") - F.col("_lat0")) / lat_step), "col": F.floor((F.col("longitude") - F.col("_lon0")) / lon_step)}).drop("_lat0", "_lon0", "_mean")


def spatial_grid(indexed: DataFrame, channels: list[str], scope: list[str] | None = None) -> DataFrame:
    """One row by pixel with the present channels in order; where cells collide the last grid_id wins. No channel raises ValueError."""
    present = [c for c in channels if c in indexed.columns]
    if not present:
        raise ValueError("none of the channels is a column")
    last = F.max_by(F.struct(*present), "grid_id")
    return indexed.groupBy(*(scope or []), "row", "col").agg(last.alias("x")).select(*(scope or []), "row", "col", *[F.col(f"x.{c}").cast("float").alias(c) for c in present])


def dense(pixels: DataFrame, channels: list[str]):
    """The raster of one window as a height x width x channels array with NaN gaps. A raster is bounded by its region, so it is collected here, at the edge."""
    import numpy as np

    rows = pixels.select("row", "col", *channels).toPandas()
    out = np.full((int(rows.row.max()) + 1, int(rows.col.max()) + 1, len(channels)), np.nan, np.float32) if len(rows) else np.zeros((0, 0, len(channels)), np.float32)
    if len(rows):
        out[rows.row, rows.col] = rows[channels].to_numpy(np.float32)
    return out


def adjacency(indexed: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """source, target and weight of the eight-neighbour graph of pixels; a pixel is its last grid_id."""
    scope = scope or []
    pixels = indexed.groupBy(*scope, "row", "col").agg(F.max("grid_id").alias("grid_id"))
    offsets = F.array(*[F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)])
    near = pixels.select(*scope, F.col("grid_id").alias("source"), F.explode(offsets).alias("o")).select(*scope, "source", F.col("o.row").alias("row"), F.col("o.col").alias("col"))
    return near.join(pixels, [*scope, "row", "col"]).select(*scope, "source", F.col("grid_id").alias("target"), F.lit(1.0).alias("weight"))
