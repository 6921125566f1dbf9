"""Queries on nearest nodes, focal weather, filled polygons, full grids and raster blocks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import grid
from ..operators import blocks, export, fill, near, weather
from ..sources.shared import new_path
from . import detection_queries as dq
from . import fixtures as fx
from . import quality_queries as qq
from .define import num, registrar, tidy, ts

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_NODES = "nodes as (select 25 + ((s_suppkey*37)%1000)/50.0::double as lat, -125 + ((s_suppkey*53)%997)/32.0::double as lon, s_acctbal::double as value, s_suppkey::bigint as node from supplier)"
_NEAREST = "nearest as (select grid_id, arg_min({node: node, lat: lat, lon: lon, value: value}, {gap: pow(longitude-lon,2)+pow(latitude-lat,2), lat: lat, lon: lon}) as x from grid, nodes group by 1)"


def _nodes(spark, d):
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select((F.lit(25) + (k * 37) % 1000 / F.lit(50.0)).alias("lat"), (F.lit(-125) + (k * 53) % 997 / F.lit(32.0)).alias("lon"), F.col("s_acctbal").cast("double").alias("value"), k.cast("long").alias("node"))


@query("with " + fx.DETECTIONS + fx.GRID + "," + _NODES + "," + _NEAREST + f" select grid_id, x.node as node, {num('x.value')} from nearest")
def nearest_node(spark, d):
    """The value of the scattered node nearest to each cell."""
    return tidy(near.nearest_grid_value(fx.cells(spark, d), _nodes(spark, d), ["node", "value"], 0.5))


_CYCLES = "cycles as (select distinct date_trunc('hour', ts)::timestamp as cycle, hour(ts) as h from events where hour(ts) % 7 not in (3, 4, 5))"
_FIELDS = "fields as (select cycle, node, value/100 + h as t, ((node*7 + h*3) % 101)::double as rh, (node % 13) - 6.0::double as u, (h % 11) - 5.0::double as v, (node % 4)::double as rain from cycles, nodes where (node + h) % 9 != 0)"
_BACK = f"""back as (select grid_id, window_ts as t, avg(frp) as temperature_2m, min(frp) as wind_speed_10m, 2 as data_quality_flag from detections group by 1, 2)"""
_FOCAL = f"""times as (select distinct window_ts as t from detections),
picked as (select t, (select max(cycle) from cycles where cycle <= t.t and cycle > date_trunc('hour', t.t) - interval 3 hour) as cycle from times t),
focal as (select p.t, n.grid_id, p.cycle, f.t as temperature_2m, round_even(sqrt(u*u+v*v)*3.6::double, 2) as wind_speed_10m, round_even(((270-degrees(atan2(v,u)))%360+360)%360, 1) as wind_direction_10m,
 round_even(greatest(0, 0.6108::double*exp(17.27::double*f.t/(f.t+237.3::double))*(1-least(greatest(rh,0),100)/100)), 4) as vpd, 3 as data_quality_flag from picked p join fields f on f.cycle = p.cycle join nearest n on n.x.node = f.node),
whole as (select t, grid_id, coalesce(f.temperature_2m, b.temperature_2m) as temperature_2m, case when f.grid_id is null then b.wind_speed_10m else f.wind_speed_10m end as wind_speed_10m, f.wind_direction_10m, f.vpd, f.cycle, coalesce(f.data_quality_flag, b.data_quality_flag, 4) as data_quality_flag
 from times cross join (select grid_id from grid) left join focal f using (t, grid_id) left join back b using (t, grid_id))"""


@query("with " + fx.DETECTIONS + fx.GRID + "," + _NODES + "," + _NEAREST + "," + _CYCLES + "," + _FIELDS + "," + _BACK + "," + _FOCAL + f" select {ts('t')}, grid_id, {ts('cycle')}, {num('temperature_2m', 'wind_speed_10m', 'wind_direction_10m', 'vpd')}, data_quality_flag from whole")
def focal_weather(spark, d):
    """Gridded fields of the newest cycle, which come with gaps in time and nodes, then the background, for every window and cell."""
    e, nodes = fx.detections(spark, d), _nodes(spark, d)
    hours = fx.table(spark, d, "events").select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("cycle")).distinct().withColumn("h", F.hour("cycle")).filter(~(F.col("h") % 7).isin(3, 4, 5))
    h, node = F.col("h"), F.col("node")
    fields = hours.crossJoin(nodes).filter((node + h) % 9 != 0).select(  # a value for each cycle and node
        "cycle", "lat", "lon", (F.col("value") / 100 + h).alias("temperature_2m"), ((node * 7 + h * 3) % 101).cast("double").alias("relative_humidity_2m"), ((node % 13) - F.lit(6.0)).alias("u"), ((h % 11) - F.lit(5.0)).alias("v"), (node % 4).cast("double").alias("precipitation"),
    )
    none = F.lit(None).cast("double")
    back = e.groupBy("grid_id", F.col("window_ts").alias("t")).agg(F.avg("frp").alias("temperature_2m"), F.min("frp").alias("wind_speed_10m")).withColumns({"relative_humidity_2m": none, "wind_direction_10m": none, "precipitation": none, "vpd": none, "data_quality_flag": F.lit(2)})
    out = weather.focal_weather(fx.cells(spark, d).select("grid_id", "latitude", "longitude"), e.select(F.col("window_ts").alias("t")).distinct(), fields, back, 0.5)
    return tidy(out.select("t", "grid_id", "cycle", "temperature_2m", "wind_speed_10m", "wind_direction_10m", "vpd", "data_quality_flag"))


_S = grid.SIZE[fx.LEVEL]
_A, _B = math.cos(math.radians(60)), math.sin(math.radians(60))
# Cells that touch a box (k, w, s, e, n): centres apart by no more than both half widths in each of four directions.
_TOUCH = f"""touched as (
 select k, q, r from (select *, (q + r/2)*{grid.ROOT3 * _S!r}::double - (w+e)/2*{grid.SHRINK!r}::double as dx, r*{1.5 * _S!r}::double - (s+n)/2 as dy, (e-w)/2*{grid.SHRINK!r}::double as hx, (n-s)/2 as hy from (
   select *, unnest(range(floor((w-2)*{grid.SHRINK!r}::double/{grid.ROOT3 * _S!r}::double - r/2)::bigint, ceil((e+2)*{grid.SHRINK!r}::double/{grid.ROOT3 * _S!r}::double - r/2)::bigint)) as q from (
    select *, unnest(range(floor((s-2)/{1.5 * _S!r}::double)::bigint, ceil((n+2)/{1.5 * _S!r}::double)::bigint)) as r from boxes)))
 where abs(dx) <= hx + {_S * grid.ROOT3 / 2!r}::double and abs(dy) <= hy + {_S!r}::double and abs(dx*{_A!r}::double + dy*{_B!r}::double) <= hx*{_A!r}::double + hy*{_B!r}::double + {_S * grid.ROOT3 / 2!r}::double
  and abs(dy*{_B!r}::double - dx*{_A!r}::double) <= hx*{_A!r}::double + hy*{_B!r}::double + {_S * grid.ROOT3 / 2!r}::double)"""


@query("with boxes as (select *, w + 0.05::double + (k%9)*0.3::double as e, s + 0.05::double + (k%7)*0.25::double as n from (select s_suppkey::bigint as k, -120 + ((s_suppkey*37)%200)*0.1::double + 0.013::double as w, 26 + ((s_suppkey*13)%140)*0.1::double + 0.017::double as s from supplier))," + _TOUCH + f" select k, '{fx.LEVEL}_'||q||'_'||r as grid_id from touched")
def polygon_fill(spark, d):
    """Every cell that a box touches, for a box of each supplier."""
    k = F.col("s_suppkey").cast("long")
    w, s = F.lit(-120) + (k * 37) % 200 * F.lit(0.1) + F.lit(0.013), F.lit(26) + (k * 13) % 140 * F.lit(0.1) + F.lit(0.017)
    rings = fx.table(spark, d, "supplier").select(k.alias("k"), fill.box(w, s, w + F.lit(0.05) + (k % 9) * F.lit(0.3), s + F.lit(0.05) + (k % 7) * F.lit(0.25)).alias("ring"))
    return fill.polygon_cells(rings, ["k"], fx.LEVEL).select("k", "grid_id")


_PAD = grid.BUFFER[fx.LEVEL]
_FULL = f"""boxes as (select region as k, min(longitude)-{_PAD} as w, min(latitude)-{_PAD} as s, max(longitude)+{_PAD} as e, max(latitude)+{_PAD} as n from detections group by 1)"""


@query("with " + fx.HEX + "," + _FULL + "," + _TOUCH + "," + dq._FUEL + f""", kept as (select k as region, q, r from touched t where not (k = 'california' and exists (select 1 from fuel f where f.q = t.q and f.r = t.r and f.fuel in (91,92,98,99)) and
  not exists (select 1 from fuel n where greatest(abs(n.q-t.q), abs(n.r-t.r), abs(n.q-t.q+n.r-t.r)) <= 1 and n.fuel not in (91,92,98,99))))
 select min(region) as region, '{fx.LEVEL}_'||q||'_'||r as grid_id, {num('latitude', 'longitude')} from (select *, round_even(r*1.5::double*{_S}, 6) as latitude, round_even((q+r/2)*({grid.ROOT3 * _S!r})/{grid.SHRINK!r}, 6) as longitude from kept) group by q, r, latitude, longitude""")
def full_grid(spark, d):
    """The grid of both regions, one of them pruned by fuel."""
    e = fx.detections(spark, d)
    bounds = e.groupBy("region").agg(F.min("longitude").alias("w"), F.min("latitude").alias("s"), F.max("longitude").alias("e"), F.max("latitude").alias("n"))
    regions = bounds.withColumns({"rank": F.when(F.col("region") == "california", 0).otherwise(1), "prune": F.col("region") == "california"})
    q, r = F.col("q"), F.col("r")
    cells = fx.hex_cells(spark, d).select("grid_id", "q", "r", "region").distinct()
    fuel = cells.select("grid_id", F.when((F.abs(q + r) % 3 == 0) & (F.col("region") == "california"), 91).when(F.abs(q) % 2 == 0, 98).otherwise(101).alias("fuel"))
    return tidy(fill.full_grid(regions, fx.LEVEL, fuel).select("region", "grid_id", "latitude", "longitude"))


@query(qq.ORACLES["spatial_grid"])
def tensor_blocks(spark, d):
    """Rasters written as dense blocks by region, read again and taken apart."""
    pixels = export.spatial_grid(qq._raster(spark, d), ["latitude", "longitude"], ["region"])
    path = new_path(spark)
    blocks.write_blocks(blocks.tensor_blocks(pixels, ["latitude", "longitude"], ["region"], 16), path, ["region"])
    return tidy(blocks.block_pixels(spark.read.parquet(path), ["latitude", "longitude"], ["region"]))
