"""Queries on weather, fusion, lags and source priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import fuse, priority, weather
from ..registry import Registry
from . import fixtures as fx
from .define import num, registrar, tidy, ts

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
REGISTRY = Registry()
_W = "with " + fx.WEATHER
_SIX = "interval 6 hour"


@query(_W + f" select grid_id, {num('wind_direction_10m')} from (select grid_id, (degrees(atan2(avg(sin(radians(wind_direction_10m))), avg(cos(radians(wind_direction_10m)))))%360+360)%360 as wind_direction_10m from weather_hourly group by 1)")
def circular_mean(spark, d):
    return tidy(fx.weather_hourly(spark, d).groupBy("grid_id").agg(scalar.circular_mean("wind_direction_10m").alias("wind_direction_10m")))


_AGG = """agg as (
 select grid_id, avg(temperature_2m) as temperature_2m, avg(relative_humidity_2m) as relative_humidity_2m, avg(wind_speed_10m) as wind_speed_10m, avg(soil_moisture_0_to_7cm) as soil_moisture_0_to_7cm, avg(vpd) as vpd,
  (degrees(atan2(avg(sin(radians(wind_direction_10m))), avg(cos(radians(wind_direction_10m)))))%360+360)%360 as wind_direction_10m, coalesce(sum(precipitation),0) as precipitation, min(data_quality_flag) as data_quality_flag,
  (least(greatest(round_even(case when max(case when coalesce(precipitation,0) >= 1 then 1 else 0 end) = 1 then 0 else greatest((epoch(max(timestamp))-epoch(min(timestamp)))/86400, 1) end, 0), 0), 365))::smallint as days_since_last_precipitation,
  sum(greatest(coalesce(wind_speed_10m,0),0)) as cumulative_wind_run_24h
 from weather_hourly group by 1),
derived as (select *, least(greatest(0.40::double*(1-least(greatest(soil_moisture_0_to_7cm/0.5::double,0),1)) + 0.25::double*least(greatest(temperature_2m/45,0),1) + 0.35::double*least(greatest(days_since_last_precipitation::double/90,0),1),0),1) as drought_index_proxy from agg)"""
_MEANS = ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "soil_moisture_0_to_7cm", "vpd", "wind_direction_10m", "precipitation", "cumulative_wind_run_24h", "drought_index_proxy")


@query(_W + "," + _AGG + f" select grid_id, {num(*_MEANS)}, data_quality_flag, days_since_last_precipitation from derived")
def weather_agg(spark, d):
    return tidy(weather.weather_aggregate(fx.weather_hourly(spark, d), ["grid_id"]))


@query(_W + "," + _AGG + " select grid_id, days_since_last_precipitation from agg")
def days_since_precip(spark, d):
    return weather.weather_aggregate(fx.weather_hourly(spark, d), ["grid_id"]).select("grid_id", "days_since_last_precipitation")


@query(_W + "," + _AGG + f" select grid_id, {num('cumulative_wind_run_24h')} from agg")
def wind_run(spark, d):
    return tidy(fx.weather_hourly(spark, d).groupBy("grid_id").agg(weather.wind_run().alias("cumulative_wind_run_24h")))


@query(_W + "," + _AGG + f" select grid_id, {num('drought_index_proxy')} from derived")
def drought_index(spark, d):
    return tidy(weather.weather_aggregate(fx.weather_hourly(spark, d), ["grid_id"]).select("grid_id", "drought_index_proxy"))


_WINDOWS = "windows as (select unnest(generate_series(timestamp '1992-01-01', timestamp '1999-01-01', interval 6 hour)) as window_ts)"


@query(_W + "," + _WINDOWS + f""" select grid_id, {ts('window_ts')}, {num('temperature_2m', 'wind_direction_10m', 'precipitation', 'data_quality_flag')} from (
 select grid_id, window_ts, avg(temperature_2m) as temperature_2m, avg(wind_direction_10m) as wind_direction_10m, coalesce(sum(precipitation),0) as precipitation, avg(data_quality_flag) as data_quality_flag
 from weather_hourly join windows on timestamp between window_ts - interval 6 hour and window_ts group by all)""")
def weather_window(spark, d):
    from ..operators.reports import backfill_calendar

    windows = backfill_calendar(spark, "1992-01-01 00:00:00", "1999-01-01 00:00:00")
    out = weather.weather_window(fx.weather_hourly(spark, d), windows, 6, ["grid_id"])
    return tidy(out.select("grid_id", "window_ts", "temperature_2m", "wind_direction_10m", "precipitation", "data_quality_flag"))


@query(_W + ", p as (select * from weather_hourly where data_quality_flag = 3) select grid_id, count(*) as n, sum(data_quality_flag) as flags from (select * from p union all select * from weather_hourly w where data_quality_flag = 0 and not exists (select 1 from p where p.grid_id = w.grid_id)) group by 1")
def hrrr_merge(spark, d):
    w = fx.weather_hourly(spark, d)
    out = weather.merge_sources(w.filter("data_quality_flag = 3"), w.filter("data_quality_flag = 0"))
    return out.groupBy("grid_id").agg(F.count("*").alias("n"), F.sum("data_quality_flag").alias("flags"))


@query("with o as (select l_orderkey, l_linenumber, l_suppkey, l_shipdate, case when l_linenumber % 3 != 1 then l_quantity end as v from lineitem) select l_orderkey, l_linenumber, " + num("v") + " from (select l_orderkey, l_linenumber, last_value(v ignore nulls) over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, v rows between unbounded preceding and current row) as v from o)")
def forward_fill(spark, d):
    rows = fx.table(spark, d, "lineitem").withColumn("v", F.when(F.col("l_linenumber") % 3 != 1, F.col("l_quantity")))
    rows = rows.withColumn("k", F.struct("l_shipdate", "l_orderkey", "l_linenumber", F.col("v").isNotNull(), "v"))
    return tidy(weather.forward_fill(rows, ["v"], ["l_suppkey"], "k").select("l_orderkey", "l_linenumber", "v"))


@query("with t as (select distinct ts as t from events), c as (select distinct date_trunc('hour', ts)::timestamp as cycle from events) select " + ts("t") + ", strftime((select max(cycle) from c where cycle <= t.t and cycle > date_trunc('hour', t.t) - interval 3 hour), '%Y-%m-%d %H:%M:%S') as cycle from t", also="asof_cycle_all")
def asof_cycle(spark, d):
    e = fx.table(spark, d, "events")
    cycles = e.select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("cycle"))
    return tidy(weather.newest_cycle(e.select(F.col("ts").alias("t")).distinct(), cycles))


_PANEL_SQL = """panel as (select grid_id, region, latitude, longitude, window_ts from grid, (select distinct window_ts from detections))"""


def _panel(spark, d):
    windows = fx.detections(spark, d).select("window_ts").distinct()
    return fx.cells(spark, d).crossJoin(F.broadcast(windows))  # the calendar: four windows a day


@query("with " + fx.FUSED + f" select grid_id, {ts('window_ts')}, active_fire_count, {num('mean_frp').replace('as mean_frp', 'as elevation_m')}, {num('slope_degrees')} from fused")
def fuse_left_join(spark, d):
    """Both sides have elevation_m: the left one stays."""
    f = fx.fire_features(spark, d).withColumn("elevation_m", F.col("mean_frp"))
    return tidy(fuse.safe_left_join(f, fx.static_features(spark, d), ["grid_id"]).select("grid_id", "window_ts", "active_fire_count", "elevation_m", "slope_degrees"))


@query("with " + fx.CLEANED + fx.GRID + "," + fx.STATIC + "," + fx.WEATHER + "," + _AGG + "," + _PANEL_SQL + f""" select p.grid_id, p.region, {ts('p.window_ts')}, coalesce(active_fire_count,0) as active_fire_count, {num('coalesce_frp', 'coalesce_conf')}, coalesce(fire_detected_binary,0) as fire_detected_binary,
 {num('temperature_2m', 'precipitation', 'elevation_m')}, case when nulls/25.0 >= 0.3 then 3 else 0 end::int as data_quality_flag from (
 select p.*, f.active_fire_count, f.fire_detected_binary, coalesce(f.mean_frp,0) as coalesce_frp, coalesce(f.max_confidence,0) as coalesce_conf, w.temperature_2m, coalesce(w.precipitation,0) as precipitation, s.elevation_m,
  (w.temperature_2m is null)::int*10 + (s.elevation_m is null)::int*4 as nulls
 from panel p left join fire f on f.grid_id = p.grid_id and f.window_ts = p.window_ts left join derived w on w.grid_id = p.grid_id left join static_features s on s.grid_id = p.grid_id) p""")
def fuse_features(spark, d):
    w = weather.weather_aggregate(fx.weather_hourly(spark, d), ["grid_id"]).drop("data_quality_flag")
    panel = fuse.safe_left_join(_panel(spark, d), w, ["grid_id"])
    out = fuse.fuse_features(panel, fx.fire_features(spark, d), None, fx.static_features(spark, d), REGISTRY)
    return tidy(out.select("grid_id", "region", "window_ts", "active_fire_count", F.col("mean_frp").alias("coalesce_frp"), F.col("max_confidence").alias("coalesce_conf"), "fire_detected_binary", "temperature_2m", "precipitation", "elevation_m", "data_quality_flag"))


_MONTH = "timestamp '2024-01-01' + to_hours((6 * ((epoch(timestamp)::bigint // 21600) % 120))::int)"


def _swapped(sql, *pairs):
    for old, new in pairs:
        if old not in sql:
            raise ValueError(f"{old!r} is not in the SQL")
        sql = sql.replace(old, new)
    return sql


@query(_swapped(ORACLES["fuse_features"], (_AGG, f"hourly as (select *, {_MONTH} as window_ts from weather_hourly)," + _swapped(_AGG, ("select grid_id, avg", "select grid_id, window_ts, avg"), ("from weather_hourly group by 1", "from hourly group by 1, 2"))),
  ("on w.grid_id = p.grid_id", "on w.grid_id = p.grid_id and w.window_ts = p.window_ts")))
def fuse_features_all(spark, d):
    """All cells and windows, weather by cell and window: its hours are put into one month of windows."""
    hour = F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("timestamp"))
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.floor(hour / 6) % 120 * 6).cast("int"))
    w = weather.weather_aggregate(fx.weather_hourly(spark, d).withColumn("window_ts", at), ["grid_id", "window_ts"]).drop("data_quality_flag")
    out = fuse.fuse_features(_panel(spark, d), fx.fire_features(spark, d), w, fx.static_features(spark, d), REGISTRY)
    return tidy(out.select("grid_id", "region", "window_ts", "active_fire_count", F.col("mean_frp").alias("coalesce_frp"), F.col("max_confidence").alias("coalesce_conf"), "fire_detected_binary", "temperature_2m", "precipitation", "elevation_m", "data_quality_flag"))


@query("with s as (select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then l_tax end as p, case when l_linenumber % 3 = 0 then l_quantity end as f, case when l_linenumber % 5 = 0 then l_discount end as t from lineitem) select l_orderkey, l_linenumber, " + num("precipitation", "mean_frp", "temperature_2m") + " from (select l_orderkey, l_linenumber, coalesce(p,0) as precipitation, coalesce(f,0) as mean_frp, t as temperature_2m from s)")
def fill_strategies(spark, d):
    n = F.col("l_linenumber")
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n % 2 == 0, F.col("l_tax")).alias("precipitation"), F.when(n % 3 == 0, F.col("l_quantity")).alias("mean_frp"), F.when(n % 5 == 0, F.col("l_discount")).alias("temperature_2m"))
    return tidy(REGISTRY.filled(rows))


@query("with s as (select l_orderkey, l_linenumber, (l_linenumber % 2 = 0)::int + (l_linenumber % 3 = 0)::int + (l_linenumber % 5 = 0)::int as nulls from lineitem) select l_orderkey, l_linenumber, case when nulls/5.0 >= 0.3 then 3 else 0 end::int as data_quality_flag from s")
def quality_flag(spark, d):
    n = F.col("l_linenumber")
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n % 2 != 0, F.col("l_tax")).alias("a"), F.when(n % 3 != 0, F.col("l_quantity")).alias("b"), F.when(n % 5 != 0, F.col("l_discount")).alias("c"))
    return fuse.quality_flag(rows).select("l_orderkey", "l_linenumber", "data_quality_flag")




@query("with " + fx.CLEANED + f""" select grid_id, {ts('window_ts')}, fire_detected_binary, active_fire_count, {num('mean_frp', 'max_confidence')} from (
 select f.grid_id, f.window_ts, f.fire_detected_binary, coalesce(p.active_fire_count,0) as active_fire_count, coalesce(p.mean_frp,0) as mean_frp, coalesce(p.max_confidence,0) as max_confidence
 from fire f left join fire p on p.grid_id = f.grid_id and p.window_ts = f.window_ts - {_SIX}) x""")
def temporal_lag(spark, d):
    f = fx.fire_features(spark, d)
    out = fuse.temporal_lag(f, f, REGISTRY, ["grid_id", "window_ts"], F.make_dt_interval(hours=F.lit(6)))
    return tidy(out.select("grid_id", "window_ts", "fire_detected_binary", "active_fire_count", "mean_frp", "max_confidence"))


@query("with " + fx.CLEANED + fx.GRID + "," + _PANEL_SQL + f""" select grid_id, {ts('window_ts')}, coalesce(lag(active_fire_count) over (partition by grid_id order by window_ts), 0) as active_fire_count from (
 select p.grid_id, p.window_ts, coalesce(f.active_fire_count,0) as active_fire_count from panel p left join fire f using (grid_id, window_ts)) x""")
def temporal_lag_window(spark, d):
    dense = fuse.fire_defaults(fuse.safe_left_join(_panel(spark, d), fx.fire_features(spark, d), ["grid_id", "window_ts"]))
    return tidy(fuse.temporal_lag_window(dense, ["active_fire_count"]).select("grid_id", "window_ts", "active_fire_count"))


@query("with " + fx.FUSED + f" select grid_id, {ts('window_ts')}, 2 as data_source_priority from fused")
def priority_noop(spark, d):
    return tidy(priority.no_override(fx.fused(spark, d)).select("grid_id", "window_ts", "data_source_priority"))


_TRUTH = """truth as (select seq, latitude+0.01::double as lat, longitude-0.01::double as lon, acq_ts as t, (seq % 40)::int as active_fire_count, case when seq % 100 != 0 then frp*2 end as mean_frp from detections where sensor_source = 'purchase')"""


@query("with " + fx.FUSED + "," + _TRUTH + f""", near as (
 select f.grid_id, f.window_ts, arg_max(t.active_fire_count, t.seq) as c, arg_max(t.mean_frp, t.seq) filter (t.mean_frp is not null) as m from fused f join truth t
  on abs(latitude-lat) <= 1 and sqrt(pow(latitude-lat,2)+pow(longitude-lon,2)) <= 5.0::double/111 and abs(epoch(t.t)::bigint - epoch(f.window_ts)::bigint) <= 21600 group by all)
 select f.grid_id, {ts('f.window_ts')}, coalesce(c, active_fire_count) as active_fire_count, {num('mean_frp')}, case when c is not null then 1 else 2 end as data_source_priority from (select f.* exclude (mean_frp), n.c, coalesce(n.m, f.mean_frp) as mean_frp from fused f left join near n using (grid_id, window_ts)) f""", also="priority_override_all")
def priority_override(spark, d):
    truth = fx.detections(spark, d).filter("sensor_source = 'purchase'").select("seq", (F.col("latitude") + 0.01).alias("latitude"), (F.col("longitude") - 0.01).alias("longitude"), F.date_trunc("SECOND", "acq_ts").cast("timestamp_ntz").alias("timestamp"), (F.col("seq") % 40).cast("int").alias("active_fire_count"), F.when(F.col("seq") % 100 != 0, F.col("frp") * 2).alias("mean_frp"))
    return tidy(priority.priority_override(fx.fused(spark, d), truth).select("grid_id", "window_ts", "active_fire_count", "mean_frp", "data_source_priority"))


@query(f"select grid_id, window_ts, n from (select 'cell_'||user_id as grid_id, strftime(date_trunc('day', ts)::timestamp + to_hours((6*(hour(ts)//6))::int), '%Y-%m-%d %H:%M:%S') as window_ts, count(*) as n from events group by all)")
def tumbling_6h(spark, d):
    rows = fx.table(spark, d, "events").select(F.concat(F.lit("cell_"), F.col("user_id")).alias("grid_id"), F.window("ts", "6 hours")["start"].alias("window_ts"))
    return tidy(rows.groupBy("grid_id", "window_ts").agg(F.count("*").alias("n")))
