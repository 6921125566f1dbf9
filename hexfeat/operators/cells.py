"""Operators on sets of grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grid
from .gates import neighbours

# Fuel codes that don't burn; 93 (farmland) is left out on purpose.
NON_BURNABLE = (91, 92, 98, 99)


def box_cells(spark: SparkSession, boxes: dict[str, tuple[float, float, float, float]], level: int) -> DataFrame:
    """grid_id, q, r, latitude, longitude and region of all cells whose centre lies in a box (west, south, east, north), widened by the level's buffer. Where boxes overlap the first one named wins."""
    pad, s = grid.BUFFER[level], grid.SIZE[level]
    rows = F.array(*[F.struct(F.lit(name).alias("region"), F.lit(i).alias("rank"), *[F.lit(float(v)).alias(k) for k, v in zip(("w", "s", "e", "n"), box, strict=True)]) for i, (name, box) in enumerate(boxes.items())])
    box = spark.range(1).select(F.explode(rows).alias("b")).select("b.*")
    rs = box.withColumn("r", F.explode(F.sequence(F.floor((F.col("s") - pad) / (1.5 * s)).cast("long"), F.ceil((F.col("n") + pad) / (1.5 * s)).cast("long"))))
    width = grid.ROOT3 * s / grid.SHRINK
    qs = rs.withColumn("q", F.explode(F.sequence(F.floor((F.col("w") - pad) / width - F.col("r") / 2).cast("long"), F.ceil((F.col("e") + pad) / width - F.col("r") / 2).cast("long"))))
    lat, lon = grid.centroid(F.col("q"), F.col("r"), level)
    inside = qs.select(grid.cell_id(F.col("q"), F.col("r"), level).alias("grid_id"), "q", "r", lat.alias("latitude"), lon.alias("longitude"), "region", "rank", "w", "s", "e", "n").filter(
        F.col("latitude").between(F.col("s") - pad, F.col("n") + pad) & F.col("longitude").between(F.col("w") - pad, F.col("e") + pad)
    )
    return keep_first(inside, ["grid_id"], ["rank"]).drop("rank", "w", "s", "e", "n")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row by key: the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def focal_grid(fires: DataFrame, level: int, rings: int = 5, least_ring: int = 0) -> DataFrame:
    """Cells up to so many rings around fire cells: grid_id, ring_distance (the least over all fires, 0 for fire cells) and cell_type."""
    q, r = grid.coordinates(F.col("grid_id"))
    around = fires.select("grid_id").distinct().select(F.explode(grid.disk(q, r, rings)).alias("c"))
    least = around.groupBy(grid.cell_id(F.col("c.q"), F.col("c.r"), level).alias("grid_id")).agg(F.min("c.ring").alias("ring_distance"))
    return least.filter((F.col("ring_distance") == 0) | (F.col("ring_distance") >= least_ring)).withColumn("cell_type", F.when(F.col("ring_distance") == 0, "fire").otherwise("detection_zone"))


def prune_cells(cells: DataFrame, fuel: DataFrame, level: int) -> DataFrame:
    """cells without those of non-burnable fuel whose whole disk is non-burnable, as far as its fuel is known."""
    own = cells.join(fuel.select("grid_id", "fuel"), "grid_id", "left").filter(F.col("fuel").isin(*NON_BURNABLE))
    around = neighbours(own, [], level, itself=True).join(fuel.select("grid_id", "fuel"), "grid_id").filter(F.col("fuel").isNotNull())
    bare = around.groupBy("source").agg(F.bool_and(F.col("fuel").isin(*NON_BURNABLE)).alias("bare")).filter("bare").select(F.col("source").alias("grid_id"))
    return cells.join(bare, "grid_id", "left_anti")


def last_of(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The last `most` rows of each key in order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
