"""Four gates against false alarms, as joins over many scans at once, and counters over consecutive scans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid, scalar

NEIGHBOURS, PERSISTENCE, BYPASS_FRP, COLD_FRP, INDUSTRY_KM = 2, 2, 50.0, 200.0, 2.0


def neighbours(cells: DataFrame, keys: list[str], level: int, k: int = 1, itself: bool = False) -> DataFrame:
    """cells exploded to the cells up to k rings away: keys, grid_id (of the neighbour), source."""
    q, r = grid.coordinates(F.col("grid_id"))
    around = cells.select(*keys, F.col("grid_id").alias("source"), F.explode(grid.disk(q, r, k)).alias("c"))
    return around.filter(F.lit(itself) | (F.col("c.ring") > 0)).select(*keys, "source", grid.cell_id(F.col("c.q"), F.col("c.r"), level).alias("grid_id"))


def gate1_spatial(cells: DataFrame, keys: list[str], level: int, least: int = NEIGHBOURS) -> DataFrame:
    """Cells with at least so many neighbours among the distinct cells of the same scan."""
    cells = cells.select(*keys, "grid_id").distinct()
    near = neighbours(cells, keys, level).join(cells, [*keys, "grid_id"]).groupBy(*keys, "source").agg(F.count("*").alias("n_neighbours"))
    return near.filter(F.col("n_neighbours") >= least).withColumnRenamed("source", "grid_id")


def gate2_temporal(cells: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that the scan before has as well (previous is keyed by the scan it precedes)."""
    return cells.join(previous.select(*keys, "grid_id").distinct(), [*keys, "grid_id"], "left_semi")


def gate3_cross_reference(cells: DataFrame, reference: DataFrame, keys: list[str], level: int, min_frp: float = 1.0) -> DataFrame:
    """Cells with a reference detection in them or in a neighbour. Keys without any reference pass (the feed is down)."""
    seen = reference.filter(F.col("frp") >= min_frp).select(*keys, "grid_id").distinct()
    confirmed = neighbours(seen, keys, level, itself=True).select(*keys, "grid_id").distinct()
    unknown = cells.join(seen.select(*keys).distinct(), keys, "left_anti")
    return cells.join(confirmed, [*keys, "grid_id"], "left_semi").unionByName(unknown)


def gate4_industrial(cells: DataFrame, sources: DataFrame, default_km: float = INDUSTRY_KM, largest_km: float = 50.0) -> DataFrame:
    """Cells (latitude, longitude) not within radius_km of an industrial source.

    Sources are dealt to all squares that their radius touches, so that the range condition is an equi-join with an
    exact filter. The side follows the largest radius present (largest_km at least) and the latitude where degrees of
    longitude are shortest, so that no circle is wider than the square and its neighbours.
    """
    found = sources.dropna(subset=["s_lat", "s_lon"]).agg(F.max(F.coalesce("radius_km", F.lit(default_km))).alias("km"), F.max(F.abs("s_lat")).alias("lat")).first()
    largest = max(largest_km, found["km"] or 0.0)
    side = max(largest_km / 80.0, largest / (111.0 * math.cos(math.radians(min(89.0, (found["lat"] or 0.0) + largest / 111.0)))))
    square = lambda c: F.floor(F.col(c) / side).cast("long")
    around = F.array(*[F.struct((square("s_lat") + dy).alias("y"), (square("s_lon") + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    near = sources.dropna(subset=["s_lat", "s_lon"]).select("s_lat", "s_lon", F.coalesce("radius_km", F.lit(default_km)).alias("radius_km")).withColumn("s", F.explode(around)).select("s_lat", "s_lon", "radius_km", F.col("s.y").alias("_y"), F.col("s.x").alias("_x"))
    placed = cells.withColumns({"_y": square("latitude"), "_x": square("longitude")})
    far = scalar.haversine_km(F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon")) <= F.col("radius_km")
    return placed.join(near, (placed._y == near._y) & (placed._x == near._x) & far, "left_anti").drop("_y", "_x")


def evaluate(scans: DataFrame, cells: DataFrame, previous: DataFrame, reference: DataFrame, sources: DataFrame | None, keys: list[str], level: int, min_scans: int = PERSISTENCE) -> tuple[DataFrame, DataFrame]:
    """The four gates in order over many scans at once: a verdict for each scan, and the fire cells of the confirmed ones.

    scans: keys, has_prior (there is a scan before it), consecutive (fire scans in a row before it). cells, reference:
    keys, grid_id, frp; previous: keys of the scan that it precedes, grid_id. A verdict holds the counts after each gate,
    max_frp and gate_failed, null where confirmed: the first gate that leaves nothing. Without a scan before, only a very
    strong fire goes on; with one that shares no cell, the scan is pending until enough scans in a row had fire; a strong
    fire needs no reference; without sources the last gate passes all. A null frp counts as 0.
    """
    own = cells.groupBy(*keys, "grid_id").agg(F.coalesce(F.max("frp"), F.lit(0.0)).alias("frp"))
    ids = own.select(*keys, "grid_id")
    lat, lon = grid.centroid(*grid.coordinates(F.col("grid_id")), level)
    passed = {"g1": gate1_spatial(ids, keys, level), "g2": gate2_temporal(ids, previous, keys), "g3": gate3_cross_reference(ids, reference, keys, level)}
    flagged = own.withColumns({g: F.lit(False) for g in passed})
    for name, kept in passed.items():  # all that passed are cells of own: one aggregate takes the place of three joins
        flagged = flagged.unionByName(kept.select(*keys, "grid_id", F.lit(None).cast("double").alias("frp"), *[F.lit(g == name).alias(g) for g in passed]))
    at = flagged.groupBy(*keys, "grid_id").agg(F.max("frp").alias("frp"), *[F.bool_or(g).alias(g) for g in passed])
    if sources is None:
        at = at.withColumn("g4", F.lit(True))
    else:
        places = ids.select("grid_id").distinct().select("grid_id", lat.alias("latitude"), lon.alias("longitude"))
        at = at.join(gate4_industrial(places, sources).select("grid_id", F.lit(True).alias("g4")), "grid_id", "left").fillna(False, ["g4"])
    # The cells of a scan are bounded by the grid of its key, so they are judged together, in one row.
    cell = F.struct("grid_id", "frp", "g1", "g2", "g3", "g4")
    found = at.groupBy(*keys).agg(F.collect_list(cell).alias("_cells"))
    told = scans.join(found, keys, "left")
    count = lambda c, holds: F.coalesce(F.size(F.filter(c, holds)).cast("long"), F.lit(0).cast("long"))
    told = told.withColumn("_cells", F.coalesce("_cells", F.array().cast(found.schema["_cells"].dataType)))
    told = told.withColumns({
        "n_candidates": F.size("_cells").cast("long"), "n_spatial": count("_cells", lambda x: x["g1"]), "n_persistent": count("_cells", lambda x: x["g1"] & x["g2"]),
        "max_frp": F.coalesce(F.array_max(F.transform("_cells", lambda x: x["frp"])), F.lit(0.0)),
    })
    persist, refer = F.col("has_prior") & (F.col("n_persistent") > 0), F.col("max_frp") < BYPASS_FRP
    told = told.withColumn("_left", F.filter("_cells", lambda x: x["g1"] & (x["g2"] | ~persist) & (x["g3"] | ~refer)))
    told = told.withColumns({"n_referred": F.size("_left"), "_fires": F.filter("_left", lambda x: x["g4"])}).withColumn("n_fire_cells", F.size("_fires").cast("long"))
    failed = (
        F.when(F.col("n_candidates") == 0, "no_detections")
        .when(F.col("n_spatial") == 0, "G1")
        .when(F.col("has_prior") & (F.col("n_persistent") == 0) & (F.col("consecutive") + 1 < min_scans), "G2_pending")
        .when(~F.col("has_prior") & (F.col("max_frp") < COLD_FRP), "G2_no_prior_scan")
        .when(F.col("n_referred") == 0, "G3")
        .when(F.col("n_fire_cells") == 0, "G4")
    )
    judged = told.withColumn("gate_failed", failed).withColumn("confirmed", F.col("gate_failed").isNull())
    verdicts = judged.select(*keys, "n_candidates", "n_spatial", "n_persistent", "max_frp", "gate_failed", "confirmed", F.when(F.col("confirmed"), F.col("n_fire_cells")).otherwise(0).alias("n_fire_cells"))
    return verdicts, judged.filter("confirmed").select(*keys, F.explode(F.transform("_fires", lambda x: x["grid_id"])).alias("grid_id"))


def run_lengths(df: DataFrame, keys: list[str], order: str, holds: Column, name: str) -> DataFrame:
    """How many rows in a row, up to this one, `holds` is true: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("_holds", F.coalesce(holds, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("_holds"), 0).otherwise(1)).over(w))
    return out.withColumn(name, F.sum(F.when(F.col("_holds"), 1).otherwise(0)).over(Window.partitionBy(*keys, "_island").orderBy(order)).cast("int")).drop("_holds", "_island")


def expanding_cells(scans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """new_cells: cells (array) of a scan that the scan before it doesn't have."""
    before = F.lag("cells").over(Window.partitionBy(*keys).orderBy(order))
    return scans.withColumn("new_cells", F.array_except("cells", F.coalesce(before, F.array().cast("array<string>"))))


#: Scans that are folded into one log before it is put behind the others.
STRETCH = 1024


def incident_replay(scans: DataFrame, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """The incident state machine over all scans of a key in order.

    scans: keys, scan_ts, cells (array), max_frp. One row for each scan: mode and the counters expanding, still and low.
    Whether a scan has new cells is found beside the scan before it; what is folded is then a time, a flag and a number
    for each scan, stretch by stretch, so that no log is copied at every step. The streaming operator does the same with
    state, and is the one to use where a key never ends. A null max_frp counts as 0.
    """
    grown = (F.size("new_cells") > 0).alias("grown")
    marked = expanding_cells(scans, keys, "scan_ts").select(*keys, F.struct("scan_ts", grown, F.coalesce("max_frp", F.lit(0.0)).alias("frp")).alias("x"))
    ordered = marked.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("s"))
    row = "struct<scan_ts:timestamp_ntz,mode:string,expanding:int,still:int,low:int>"
    state = f"struct<mode:string,prior:string,expanding:int,still:int,low:int,log:array<{row}>>"
    outer = f"struct<last:{state},logs:array<array<{row}>>>"
    zero = F.from_json(F.lit('{"mode":"quiet","prior":"quiet","expanding":0,"still":0,"low":0,"log":[]}'), state)

    def merge(a: Column, x: Column) -> Column:
        burning = a["mode"] == "emergency"
        still = F.when(burning & ~x["grown"], a["still"] + 1).otherwise(0)
        low = F.when(burning & (x["frp"] < BYPASS_FRP), a["low"] + 1).otherwise(0)
        ends = burning & ((still >= 3) | (low >= 2))
        expanding = F.when(burning, a["expanding"]).when((x["frp"] >= COLD_FRP) & x["grown"], a["expanding"] + 1).otherwise(0)
        starts = ~burning & (x["frp"] >= COLD_FRP) & (expanding >= 2)
        mode = F.when(ends, a["prior"]).when(starts, "emergency").otherwise(a["mode"])
        prior = F.when(starts, a["mode"]).otherwise(a["prior"])
        counters = [expanding.alias("expanding"), F.when(ends | starts, 0).otherwise(still).alias("still"), F.when(ends | starts, 0).otherwise(low).alias("low")]
        told = F.struct(x["scan_ts"].alias("scan_ts"), mode.alias("mode"), *counters)
        return F.struct(mode.alias("mode"), prior.alias("prior"), *counters, F.concat(a["log"], F.array(told)).alias("log")).cast(state)

    def stretched(a: Column, part: Column) -> Column:
        empty = F.array().cast(f"array<{row}>")
        last = F.aggregate(part, a["last"].withField("log", empty), merge)
        return F.struct(last.alias("last"), F.concat(a["logs"], F.array(last["log"])).alias("logs")).cast(outer)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / stretch).cast("int")), lambda i: F.slice("s", i * stretch + 1, F.lit(stretch)))
    start = F.struct(zero.alias("last"), F.array().cast(f"array<array<{row}>>").alias("logs")).cast(outer)
    folded = ordered.withColumn("parts", parts).select(*keys, F.explode(F.flatten(F.aggregate("parts", start, stretched)["logs"])).alias("x"))
    return folded.select(*keys, "x.scan_ts", "x.mode", "x.expanding", "x.still", "x.low")
