"""Queries on readers, writers, coercions, registry projections and small functions, over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import grid, scalar
from ..operators import bias, cells, reports
from ..registry import Registry
from ..sources import io
from ..sources.shared import new_path
from . import fixtures as fx
from . import quality_queries as qq
from .define import num, registrar, tidy, ts

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
_D = "with " + fx.DETECTIONS


@query(_D + f""" select region, sensor_source, {num('latitude', 'longitude')}, case when seq % 17 = 0 then null else round(frp, 6) + 0.0 end as frp, case when seq % 19 = 0 then null else strftime(date_trunc('minute', acq_ts), '%Y-%m-%d %H:%M:%S') end as acq_ts from detections""")
def csv_detections(spark, d):
    """Detections as CSV files by region and sensor, read with their types, tagged and united; malformed numbers and times are null."""
    rows, path = fx.detections(spark, d), new_path(spark)
    hhmm = (F.hour("acq_ts") * 100 + F.minute("acq_ts")).cast("string")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    out = rows.select("region", "sensor_source", "latitude", "longitude", *none("brightness", "scan", "track"), F.date_format("acq_ts", "yyyy-MM-dd").alias("acq_date"), F.when(F.col("seq") % 19 == 0, "x").otherwise(hhmm).alias("acq_time"), *none("satellite", "instrument"), "confidence", *none("version", "bright_t31"), F.when(F.col("seq") % 17 == 0, "oops").otherwise(F.col("frp").cast("string")).alias("frp"), *none("daynight"))
    out.write.partitionBy("region", "sensor_source").option("header", True).csv(path)
    there = {(r["region"], r["sensor_source"]) for r in rows.select("region", "sensor_source").distinct().collect()}  # a file for each
    found = io.read_detections(spark, {(g, s): f"{path}/region={g}/sensor_source={s}" for g, s in there})
    return tidy(found.select("region", "sensor_source", "latitude", "longitude", "frp", F.col("acq_ts").cast("timestamp_ntz").alias("acq_ts")))


@query("with " + fx.WEATHER + f" select grid_id, {ts('timestamp')}, {num('temperature_2m', 'precipitation')}, data_quality_flag from weather_hourly")
def csv_weather(spark, d):
    """Hourly weather as CSV, read again by schema."""
    path = new_path(spark)
    columns = [c.split()[0] for c in io.WEATHER_COLUMNS.split(", ")]
    w = fx.weather_hourly(spark, d).withColumn("fire_weather_index", F.lit(None).cast("double"))
    w.select(*columns).write.option("header", True).csv(path)
    return tidy(io.read_weather(spark, path).select("grid_id", "timestamp", "temperature_2m", "precipitation", "data_quality_flag"))


@query(_D + """, days as (select acq_ts::date as day, seq, region, frp from detections) select seq, coalesce(case when seq % 3 != 0 then region end, 'unknown') as region, coalesce(case when seq % 5 != 0 then round(frp, 6) end, -1.0) as frp from days where day(day) % 7 != 3""")
def json_records(spark, d):
    """Records by the day in JSON files: those of malformed files are left out, absent fields take defaults."""
    path = new_path(spark)
    record = F.to_json(F.struct("seq", F.when(F.col("seq") % 3 != 0, F.col("region")).alias("region"), F.when(F.col("seq") % 5 != 0, F.round("frp", 6)).alias("frp")))
    days = fx.detections(spark, d).withColumn("day", F.to_date("acq_ts")).groupBy("day").agg(F.array_join(F.collect_list(record), ",").alias("value"))  # the records of a day are a file
    days.select("day", F.when(F.dayofmonth("day") % 7 == 3, "[{not json").otherwise(F.concat(F.lit("["), "value", F.lit("]"))).alias("value")).write.partitionBy("day").text(path)
    return io.read_records(spark, path, "seq long, region string, frp double", {"region": "unknown", "frp": -1.0}).select("seq", "region", "frp")


@query("with " + fx.FUSED + f" select grid_id, {ts('window_ts')}, region, year(window_ts)::int as year, month(window_ts)::int as month, strftime(window_ts::date, '%Y-%m-%d') as date, active_fire_count, {num('mean_frp')} from fused")
def partitioned_export(spark, d):
    """The fused table written by region, year and month, then half of it again, and read back."""
    path, f = new_path(spark), fx.fused(spark, d).select("grid_id", "window_ts", "region", "active_fire_count", "mean_frp")
    io.export_features(f, path)
    io.export_features(f.filter("region = 'texas'"), path)
    back = io.read_features(spark, path)
    return tidy(back.select("grid_id", "window_ts", "region", "year", "month", F.date_format("date", "yyyy-MM-dd").alias("date"), "active_fire_count", "mean_frp"))


@query(_D + """, v as (select seq, case seq % 6 when 0 then 'x'||seq when 1 then '' when 2 then 'NaN' when 3 then ' '||(seq/4.0)::varchar||' ' else (seq/8.0)::varchar end as n from detections)
 select seq, case when seq % 6 in (0, 1, 2) then null when seq % 6 = 3 then round(seq/4.0::double, 6) else round(seq/8.0::double, 6) end as value, case when seq % 4 = 0 then null else strftime(date_trunc('second', acq_ts), '%Y-%m-%d %H:%M:%S') end as at from v join detections using (seq)""")
def coercions(spark, d):
    """Text to numbers and times, null where it is neither."""
    seq = F.col("seq")
    text = F.when(seq % 6 == 0, F.concat(F.lit("x"), seq)).when(seq % 6 == 1, "").when(seq % 6 == 2, "NaN").when(seq % 6 == 3, F.concat(F.lit(" "), (seq / 4).cast("string"), F.lit(" "))).otherwise((seq / 8).cast("string"))
    time = F.when(seq % 4 == 0, F.lit("2024-13-45 no")).otherwise(F.date_format("acq_ts", "yyyy-MM-dd HH:mm:ss"))
    return tidy(fx.detections(spark, d).select("seq", scalar.number(text).alias("value"), F.try_to_timestamp(time).cast("timestamp_ntz").alias("at")))


_R = Registry()


@query("with " + fx.FUSED + ", one as (select *, (select list(f) from (values " + ", ".join(f"('{n}')" for n in _R.names()) + ") t(f)) as names from fused)" + f""" select grid_id, {ts('window_ts')}, {num('mean_frp', 'latitude')}, null::double as ndvi, len(names)::int as n_features, {len(_R.names(nullable=False))} as n_required, {len(_R.names('weather'))} as n_weather from one""")
def registry_columns(spark, d):
    """All features of the registry in order: present ones as they are, absent ones null, cast to their types; and projections of the registry."""
    f = fx.fused(spark, d)
    out = _R.arranged(f, cast=False)
    assert out.columns[: len(_R.names())] == _R.names()
    typed = _R.empty(spark).unionByName(_R.arranged(f, cast=True).select(*_R.names()))
    assert typed.schema.names == _R.schema().names
    return tidy(out.select("grid_id", "window_ts", "mean_frp", "latitude", F.col("ndvi").cast("double").alias("ndvi"), F.lit(len(_R.names())).alias("n_features"), F.lit(len(_R.names(nullable=False))).alias("n_required"), F.lit(len(_R.names("weather"))).alias("n_weather")))


@query(_D + f""" select sensor_source, seq, strftime(date_trunc('minute', acq_ts), '%Y-%m-%d %H:%M:%S') as scan_ts from detections qualify row_number() over (partition by sensor_source, region order by date_trunc('minute', acq_ts) desc, seq desc) <= 6""")
def last_scans(spark, d):
    """The six newest files of each sensor and region, by the time in their names."""
    name = F.concat(F.lit("OR_ABI-L2-FDCC_s"), F.date_format("acq_ts", "yyyyDDDHHmm"), F.lit("213_e.nc"))
    files = fx.detections(spark, d).select("sensor_source", "region", "seq", scalar.scan_time(name).cast("timestamp_ntz").alias("scan_ts"))
    return tidy(cells.last_of(files, ["sensor_source", "region"], ["scan_ts", "seq"], 6).select("sensor_source", "seq", "scan_ts"))


_S = grid.SIZE[grid.LEVELS[22]]
_CORNERS = " union all ".join(f"select grid_id, {i} as corner, lon + {math.cos(math.radians(60 * i + 30)) * _S / grid.SHRINK!r}::double as lon, lat + {math.sin(math.radians(60 * i + 30)) * _S!r}::double as lat from centre" for i in range(6))


@query("with " + fx.HEX + f", centre as (select distinct grid_id, round_even(r*1.5::double*{_S}, 6) as lat, round_even((q+r/2)*({grid.ROOT3 * _S!r})/{grid.SHRINK!r}, 6) as lon from hex), corners as ({_CORNERS}) select grid_id, corner, {num('lon', 'lat')}, round({grid.area_km2(5)!r}::double, 6) + 0.0::double as area_km2 from corners")
def cell_geometry(spark, d):
    """Corners and area of every cell with fire at the level of 22 km."""
    level = grid.level_of(22)
    found = fx.hex_cells(spark, d).select("grid_id", "q", "r").distinct().select("grid_id", F.posexplode(grid.boundary(F.col("q"), F.col("r"), level)).alias("corner", "p"))
    return tidy(found.select("grid_id", "corner", "p.lon", "p.lat", F.lit(grid.area_km2(level)).alias("area_km2")))


@query("select distinct strftime(c, '%Y-%m-%d %H:%M:%S') as cycle, 'hrrr.'||strftime(c, '%Y%m%d')||'/conus/hrrr.t'||strftime(c, '%H')||'z.wrfsfcf00.grib2' as key from (select date_trunc('hour', ts)::timestamp as c from events)")
def forecast_keys(spark, d):
    """The object key of every hourly cycle."""
    hours = fx.table(spark, d, "events").select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("cycle")).distinct()
    return tidy(hours.select("cycle", scalar.forecast_key(F.col("cycle")).alias("key")))


@query("select p_partkey, replace(replace(p_name||'/'||p_size, '/', '_'), ' ', '_') as path from part")
def path_names(spark, d):
    """Names that can be part of a path."""
    return fx.table(spark, d, "part").select("p_partkey", scalar.path_name(F.concat("p_name", F.lit("/"), F.col("p_size").cast("string"))).alias("path"))


_MODES = {"quiet": {"resolution_km": 64, "lookback_hours": 24}, "active": {"resolution_km": 64, "lookback_hours": 2}, "emergency": {"resolution_km": 22, "lookback_hours": 2}}


@query(_D + """ select seq, case when m = 'emergency' then 22 else 64 end as resolution_km, case when m in ('emergency', 'active') then 2 else 24 end as lookback_hours from (select seq, case sensor_source when 'error' then 'emergency' when 'view' then 'active' when 'click' then 'other' when 'purchase' then 'quiet' end as m from detections)""")
def mode_parameters(spark, d):
    """What each mode asks of the pipeline; an unknown or missing one counts as quiet."""
    mode = scalar.mapped(F.col("sensor_source"), {"error": "emergency", "view": "active", "click": "other", "purchase": "quiet"})
    return reports.mode_parameters(fx.detections(spark, d).select("seq", mode.alias("mode")), _MODES).select("seq", "resolution_km", "lookback_hours")


@query("select s_suppkey, coalesce(lat between 24.5 and 49.5 and lon between -125 and -66.5, false) as covered from (select s_suppkey, case when s_suppkey % 10 != 0 then 20 + ((s_suppkey*37)%1000)/25.0::double end as lat, -130 + ((s_suppkey*53)%997)/12.0::double as lon from supplier)")
def forecast_points(spark, d):
    """Points that the national forecasts cover."""
    k = F.col("s_suppkey")
    lat = F.when(k % 10 != 0, F.lit(20) + (k * 37) % 1000 / F.lit(25.0))
    return fx.table(spark, d, "supplier").select("s_suppkey", scalar.has_forecast(lat, F.lit(-130) + (k * 53) % 997 / F.lit(12.0)).alias("covered"))


@query("with " + fx.FUSED + ", s as (select 'region' as slice_dimension, region as slice_value from fused union select 'fires', active_fire_count::varchar from fused union select 'fuel', fuel_model_fbfm40::varchar from fused) select slice_dimension, slice_value, row_number() over (partition by slice_dimension order by slice_value)::int as position from s where slice_value is not null")
def slice_values(spark, d):
    """Values of each dimension in the order of their texts."""
    return bias.slice_values(fx.fused(spark, d), {"region": "region", "fires": "active_fire_count", "fuel": "fuel_model_fbfm40"})
