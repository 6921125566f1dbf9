"""Polygons to the grid cells that they touch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from . import cells as cell_ops

#: Rows of cells that a task takes at once from a region.
BAND = 16
#: Widths of a cell by which runs of cells are widened for rounding, before each cell is tested.
ROOM = 1e-6
#: Directions in which the edges of a cell (pointed at the top) look, on the plane of the grid.
_LOOKS = tuple((math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (0, 60, 120))
_CORNERS = tuple((math.cos(math.radians(60 * i + 30)), math.sin(math.radians(60 * i + 30))) for i in range(3))


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A box as a ring of (lon, lat)."""
    return F.array(*[F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat")) for lon, lat in ((west, south), (east, south), (east, north), (west, north))])


def spans(ring: Column, size: float) -> Column:
    """What a convex polygon covers along each direction that may part it from a hexagon of this size (centre to corner): an array of a, b, low, high and half, the hexagon's own reach.

    Two convex shapes are apart if and only if one of the directions of their edges separates them: three are the
    hexagon's, the others those of the polygon's own edges.
    """
    points = F.transform(ring, lambda p: F.struct((p["lon"] * grid.SHRINK).alias("x"), p["lat"].alias("y")))
    n = F.size(points)
    edges = F.transform(points, lambda p, i: F.struct((p["y"] - F.element_at(points, (i + 1) % n + 1)["y"]).alias("a"), (F.element_at(points, (i + 1) % n + 1)["x"] - p["x"]).alias("b")))
    looks = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _LOOKS])

    def span(e: Column) -> Column:
        along = F.transform(points, lambda p: p["x"] * e["a"] + p["y"] * e["b"])
        half = F.greatest(*[F.abs(cx * e["a"] + cy * e["b"]) for cx, cy in _CORNERS]) * size
        return F.struct(e["a"].alias("a"), e["b"].alias("b"), F.array_min(along).alias("low"), F.array_max(along).alias("high"), half.alias("half"))

    return F.transform(F.concat(looks, edges), span)


def touches(found: Column, x: Column, y: Column) -> Column:
    """Whether the polygon of these spans touches the hexagon around (x, y); points of the plane count. Shapes that only meet at their rims touch."""
    centre = lambda e: x * e["a"] + y * e["b"]
    return F.forall(found, lambda e: (e["low"] <= centre(e) + e["half"]) & (e["high"] >= centre(e) - e["half"]))


def _place(q: Column, r: Column, level: int) -> tuple[Column, Column]:
    """Centre of a cell on the plane."""
    s = grid.SIZE[level]
    return (q + r / 2) * (grid.ROOT3 * s), r * (1.5 * s)


def _columns(found: Column, y: Column) -> tuple[Column, Column]:
    """Between which x the hexagons around (x, y) touch, for a given y; each direction that isn't nearly upright bounds them."""
    at = lambda e, way: (F.when(way, e["high"] + e["half"]).otherwise(e["low"] - e["half"]) - y * e["b"]) / e["a"]
    slanted = F.filter(found, lambda e: F.abs(e["a"]) > 1e-3 * (F.abs(e["a"]) + F.abs(e["b"])))
    return F.array_max(F.transform(slanted, lambda e: at(e, e["a"] < 0))), F.array_min(F.transform(slanted, lambda e: at(e, e["a"] > 0)))


def polygon_cells(regions: DataFrame, keys: list[str], level: int) -> DataFrame:
    """keys, grid_id, q, r, latitude and longitude of all cells of the level that a region touches, rims included.

    regions: keys and ring, a convex polygon as an array of (lon, lat), open or closed. Regions are cut into bands of BAND
    rows of cells and these dealt to all tasks, so neither many regions in one small file nor a large one stay in one task.
    In a row the cells that touch are a run of columns, whose ends follow from the ring; each cell between them is tested. A null or empty ring has no cells.
    """
    rings = regions.filter(F.size(F.coalesce("ring", F.array().cast(regions.schema["ring"].dataType))) > 0)
    rings = rings.withColumn("ring", F.when((F.size("ring") > 1) & (F.element_at("ring", 1) == F.element_at("ring", -1)), F.slice("ring", F.lit(1), F.size("ring") - 1)).otherwise(F.col("ring")))
    s, lats = grid.SIZE[level], F.transform("ring", lambda p: p["lat"])
    up, width = 1.5 * s, grid.ROOT3 * s
    low, high = F.ceil((F.array_min(lats) - s) / up - ROOM).cast("long"), F.floor((F.array_max(lats) + s) / up + ROOM).cast("long")
    bands = rings.select(*keys, "ring", low.alias("_low"), high.alias("_high")).select("*", F.explode(F.sequence(F.floor(F.col("_low") / BAND), F.floor(F.col("_high") / BAND))).alias("_band"))
    tasks = max(regions.sparkSession.sparkContext.defaultParallelism, int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bands = bands.repartition(tasks).withColumn("_spans", spans(F.col("ring"), s))
    rows = bands.select(*keys, "_spans", F.explode(F.sequence(F.greatest("_low", F.col("_band") * BAND), F.least("_high", F.col("_band") * BAND + BAND - 1))).alias("r"))
    west, east = _columns(F.col("_spans"), _place(F.lit(0), F.col("r"), level)[1])
    column = lambda x: x / width - F.col("r") / 2
    ends = rows.select("*", F.ceil(column(west) - ROOM).alias("_west"), F.floor(column(east) + ROOM).alias("_east")).filter("_west <= _east")
    cells = ends.select(*keys, "_spans", "r", F.explode(F.sequence("_west", "_east")).alias("q"))
    found = cells.filter(touches(F.col("_spans"), *_place(F.col("q"), F.col("r"), level)))
    lat, lon = grid.centroid(F.col("q"), F.col("r"), level)
    return found.select(*keys, grid.cell_id(F.col("q"), F.col("r"), level).alias("grid_id"), "q", "r", lat.alias("latitude"), lon.alias("longitude"))


def full_grid(regions: DataFrame, level: int, fuel: DataFrame | None = None) -> DataFrame:
    """The grid of all regions: region, grid_id, q, r, latitude, longitude; each cell once.

    regions: region, rank, w, s, e, n and prune. Boxes are widened by the level's buffer; of the cells of regions with
    prune those go whose fuel and all around is known not to burn (fuel: grid_id, fuel; None prunes nothing); of regions
    that share a cell the one with the lower rank has it.
    """
    pad = F.lit(grid.BUFFER[level])
    rings = regions.select("region", "rank", "prune", box(F.col("w") - pad, F.col("s") - pad, F.col("e") + pad, F.col("n") + pad).alias("ring"))
    cells = polygon_cells(rings, ["region", "rank", "prune"], level)
    if fuel is not None:
        barren = cells.filter("prune")
        cells = cells.filter("not prune").unionByName(cell_ops.prune_cells(barren, fuel, level))
    return cell_ops.keep_first(cells, ["grid_id"], ["rank"]).select("region", "grid_id", "q", "r", "latitude", "longitude")
