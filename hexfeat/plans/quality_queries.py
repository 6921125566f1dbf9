"""Queries on data quality, anomalies, bias, exports, backfill, reports and parsed payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import anomaly, bias, export, quality, reports
from ..registry import Registry
from ..sources import backfill, io, parsers
from ..sources.shared import new_path
from . import fixtures as fx
from .define import num, registrar, tidy, ts

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
_U = "with " + fx.FUSED
_COLUMNS = ["mean_frp", "max_confidence", "elevation_m"]

_CHECKED = ("grid_id", "region", "latitude", "longitude", "active_fire_count", "mean_frp", "max_confidence", "fire_detected_binary", "elevation_m", "slope_degrees", "fuel_model_fbfm40")


def _validate_sql() -> str:
    """The expectations of the checked columns, one select for each."""
    registry, rows = Registry(), []
    kinds = {"string": "string", "grid_id": "string"}
    numeric = {c for c in _CHECKED if c not in ("grid_id", "region")}
    doubles = {"latitude", "longitude", "mean_frp", "max_confidence", "elevation_m", "slope_degrees"}
    for f in registry.features:
        n = f.name
        have = n in _CHECKED
        rows.append(f"select 'exists' as expectation, '{n}' as column_name, {str(have).lower()} as success, {float(have)}::double as observed")
        if not have:
            continue
        family = "float" if f.type.startswith("float") else "int" if f.type.startswith("int") else kinds.get(f.type)
        actual = "string" if n not in numeric else "float" if n in doubles else "int"
        if family:
            rows.append(f"select 'type', '{n}', {str(family == actual).lower()}, {float(family == actual)}::double")
        if n in numeric and (f.low is not None or f.high is not None):
            low = f"{n} < {f.low}" if f.low is not None else "false"
            high = f"{n} > {f.high}" if f.high is not None else "false"
            rows.append(f"select 'range', '{n}', count(*) filter ({low} or {high}) = 0, (count(*) filter ({low} or {high}))::double from fused")
        if f.allowed:
            rows.append(f"select 'allowed', '{n}', count(*) filter ({n} not in {f.allowed}) = 0, (count(*) filter ({n} not in {f.allowed}))::double from fused")
        nulls = f"count(*) filter ({n} is null)"
        if f.nullable:
            rows.append(f"select 'mostly_present', '{n}', {nulls} <= 0.15*count(*) or count(*) = 0, ({nulls})::double from fused")
        else:
            rows.append(f"select 'not_null', '{n}', {nulls} = 0, ({nulls})::double from fused")
    rows.append("select 'unique', 'grid_id', count(grid_id) = 0 or count(distinct grid_id) >= 0.99*count(grid_id), count(distinct grid_id)::double from fused")
    rows.append("select 'row_count', '', abs(count(*) - 8000) <= 0.05*8000, count(*)::double from fused")
    return _U + " " + " union all ".join(rows)


@query(_validate_sql())
def validate_schema(spark, d):
    return quality.validate_schema(fx.fused(spark, d).select(*_CHECKED), Registry(), expected_rows=8000)


@query(_U + " " + " union all ".join(f"select '{c}' as feature, round(avg(({c} is null)::int), 6) as null_rate from fused" for c in _COLUMNS))
def null_rates(spark, d):
    return quality.null_rates(fx.fused(spark, d), _COLUMNS)


_LONG = "long as (" + " union all ".join(f"select region, window_ts, '{c}' as feature, {c}::double as value from fused where {c} is not null" for c in _COLUMNS) + ")"
_SPLIT = "window_ts < timestamp '2024-01-16'"


@query(_U + "," + _LONG + f" select feature, count(*) as n, {num('mean', 'std')} from (select feature, value, avg(value) over (partition by feature) as mean, sqrt(var_pop(value) over (partition by feature) * count(*) over (partition by feature) / greatest(count(*) over (partition by feature) - 1, 1)) as std from long) group by feature, mean, std")
def welford_merge(spark, d):
    f = fx.fused(spark, d)
    first = F.col("window_ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    old, new = anomaly.moments(f.filter(first), _COLUMNS, []), anomaly.moments(f.filter(~first), _COLUMNS, [])
    return tidy(anomaly.merge_moments(old, new, ["feature"]).select("feature", "n", "mean", "std"))


@query(_U + "," + _LONG + f""", base as (select feature, count(*) as n, avg(value) as mean, sqrt(var_pop(value)*count(*)/greatest(count(*)-1,1)) as std from long where {_SPLIT} group by 1)
 select feature, 'off_season' as season, count(*) filter (z > 3.5) as n_anomalies, {num('max_abs_z')} from (select *, max(z) over (partition by feature) as max_abs_z from (select l.feature, abs((value-mean)/std) as z from long l join base b using (feature) where not ({_SPLIT}) and b.n >= 500 and std > 0)) group by feature, max_abs_z having count(*) >= 10 and count(*) filter (z > 3.5) > 0""")
def zscore_anomalies(spark, d):
    f = fx.fused(spark, d).withColumn("season", scalar.season(F.col("window_ts")))
    first = F.col("window_ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    empty = anomaly.moments(f.filter("false"), _COLUMNS, ["season"])
    base = anomaly.merge_moments(empty, anomaly.moments(f.filter(first), _COLUMNS, ["season"]), ["feature", "season"])
    return tidy(anomaly.zscore_anomalies(f.filter(~first), base, _COLUMNS))


@query(_U + "," + _LONG + " select feature, count(*) as n, round(avg(value),4) as mean, round(stddev_samp(value),4) as std, round(quantile_cont(value,0.5),4) as median, round(quantile_cont(value,0.05),4) as p5, round(quantile_cont(value,0.95),4) as p95, round(1 - count(*)::double/(select count(*) from fused), 4) as null_rate from long group by 1")
def slice_stats(spark, d):
    return bias.slice_stats(fx.fused(spark, d), _COLUMNS)


_DIMENSIONS = {"geographic_region": "region", "data_quality_tier": "tier", "fuel_model_tier": "fuel"}


def _sliced(spark, d):
    f = fx.fused(spark, d)
    return f.withColumns({"season": scalar.season(F.col("window_ts")), "tier": scalar.quality_tier(F.col("data_quality_flag")), "fuel": scalar.fuel_tier(F.col("fuel_model_fbfm40")), "strong": (F.col("mean_frp") >= 60).cast("int")})


_TIER_SQL = "case " + " ".join(f"when fuel_model_fbfm40 in ({', '.join(map(str, codes))}) then '{tier}'" for tier, codes in scalar.FUEL_TIERS.items()) + " else 'unknown' end"
_SLICED = f"sliced as (select *, case when data_quality_flag <= 2 then 'tier_a' when data_quality_flag is not null then 'tier_b' end as tier, {_TIER_SQL} as fuel, (mean_frp >= 60)::int as strong from fused)"
_DIMS_SQL = " union all ".join(f"select '{label}' as slice_dimension, {c}::varchar as slice_value, * from sliced where {c} is not null" for label, c in _DIMENSIONS.items())


@query(_U + "," + _SLICED + f", dims as ({_DIMS_SQL})" + """ select slice_dimension, slice_value, row_count, round(row_count*100.0/n_all, 4) as pct_of_total, round(rate, 6) as fire_rate, round(abs(rate-rate_all), 6) as fire_rate_disparity, abs(rate-rate_all) > 0.05 as fire_rate_biased from
 (select slice_dimension, slice_value, count(*) as row_count, avg(strong) as rate from dims group by all having count(*) >= 10), (select count(*) as n_all, avg(strong) as rate_all from sliced)""")
def bias_slices(spark, d):
    return bias.bias_slices(_sliced(spark, d), "strong", _DIMENSIONS)


@query(_U + "," + _SLICED + f", dims as ({_DIMS_SQL})" + """,
 v as (select slice_dimension, slice_value, unnest(['mean_frp','max_confidence','elevation_m']) as feature, unnest([mean_frp, max_confidence, elevation_m]) as value from dims),
 a as (select unnest(['mean_frp','max_confidence','elevation_m']) as feature, unnest([mean_frp, max_confidence, elevation_m]) as value from sliced),
 rg as (select feature, min(value) as lo, max(value) as hi, count(value) as n_all from a where value is not null group by 1),
 q as (select feature, least(floor((value-lo)/(hi-lo)*20),19) as bin, count(*) as c_all from a join rg using (feature) where value is not null group by all),
 p as (select slice_dimension, slice_value, feature, least(floor((value-lo)/(hi-lo)*20),19) as bin, count(*) as c from v join rg using (feature) where value is not null group by all),
 n as (select slice_dimension, slice_value, feature, sum(c) as n from p group by all)""" + f"""
 select slice_dimension, slice_value, feature, {num('kl')} from (select n.slice_dimension, n.slice_value, n.feature, greatest(sum(case when n.n >= 5 then (coalesce(c,0)/n.n+1e-10)*ln((coalesce(c,0)/n.n+1e-10)/(c_all/n_all+1e-10)) else 0 end), 0) as kl
  from n join q using (feature) join rg using (feature) left join p on p.slice_dimension = n.slice_dimension and p.slice_value = n.slice_value and p.feature = n.feature and p.bin = q.bin group by all)""")
def kl_divergence(spark, d):
    return tidy(bias.kl_divergence(_sliced(spark, d), _COLUMNS, _DIMENSIONS))


#: The four dimensions of the whole analysis; the SQL of the two queries above holds the first three.
_ALL_DIMENSIONS = _DIMENSIONS | {"fire_season": "season"}
_ALL_DIMS_SQL = _DIMS_SQL + " union all select 'fire_season' as slice_dimension, case when month(window_ts) between 6 and 11 then 'fire_season' else 'off_season' end as slice_value, * from sliced where window_ts is not null"


@query(ORACLES["bias_slices"].replace(_DIMS_SQL, _ALL_DIMS_SQL))
def bias_slices_all(spark, d):
    return bias.bias_slices(_sliced(spark, d), "strong", _ALL_DIMENSIONS)


@query(ORACLES["kl_divergence"].replace(_DIMS_SQL, _ALL_DIMS_SQL))
def kl_divergence_all(spark, d):
    return tidy(bias.kl_divergence(_sliced(spark, d), _COLUMNS, _ALL_DIMENSIONS))


@query(_U + "," + _SLICED + f", dims as ({_ALL_DIMS_SQL}) " + " union all ".join(f"select slice_dimension, slice_value, '{c}' as feature, round(avg(({c} is null)::int), 4) as null_rate from dims group by slice_dimension, slice_value having count(*) >= 10" for c in _COLUMNS))
def slice_null_rates(spark, d):
    return bias.slice_null_rates(_sliced(spark, d), _COLUMNS, _ALL_DIMENSIONS)


_ONE = "(values (0)) v(i)"
_FINDINGS = """shifted as (select slice_dimension, slice_value, printf('%s = %s: %s is distributed differently from the whole (KL %.3f, limit %.1f)', slice_dimension, slice_value, feature, round(kl, 3), 0.1::double) as finding from kl where kl > 0.1),
uneven as (select slice_dimension, slice_value, printf('%s = %s: fires are detected at a rate of %.3f, %.3f from the overall rate (limit %.2f)', slice_dimension, slice_value, round(fire_rate, 3), round(fire_rate_disparity, 3), 0.05::double) as finding from slices where fire_rate_biased),
found as (select * from shifted union all select * from uneven)"""


@query("with kl as (" + ORACLES["kl_divergence_all"] + "), slices as (" + ORACLES["bias_slices_all"] + ")," + _FINDINGS + " select * from found union all select '', '', 'no slice differs beyond the limits' from " + _ONE + " where not exists (select 1 from found)")
def findings_text(spark, d):
    s = _sliced(spark, d)
    return bias.findings(bias.bias_slices(s, "strong", _ALL_DIMENSIONS), bias.kl_divergence(s, _COLUMNS, _ALL_DIMENSIONS))


@query("select p_partkey, case when p_size % 10 = 9 then 'unknown' else " + _TIER_SQL.replace("fuel_model_fbfm40", "code") + " end as tier from (select p_partkey, p_size, list_value(" + ", ".join(map(str, fx.FUELS)) + ")[p_size % 10 + 1] as code from part)")
def fuel_tier(spark, d):
    return fx.table(spark, d, "part").join(fx.static_features(spark, d).select(F.substring("grid_id", 6, 20).cast("long").alias("p_partkey"), "fuel_model_fbfm40"), "p_partkey").select("p_partkey", scalar.fuel_tier(F.col("fuel_model_fbfm40")).alias("tier"))


@query("select o_orderkey, case when month(o_orderdate) between 6 and 11 then 'fire_season' else 'off_season' end as season from orders")
def season(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", scalar.season(F.col("o_orderdate")).alias("season"))


@query(_U + " select region, count(*) as row_count, count(distinct window_ts::date) filter (fire_detected_binary = 1) as fire_event_days, count(distinct grid_id) filter (fire_detected_binary = 1) as unique_fire_cells, round(avg((data_quality_flag <= 2)::int), 3) as quality_flag_ok_pct, count(distinct window_ts::date) >= 50 and count(distinct grid_id) >= 30 and avg((data_quality_flag <= 2)::int) >= 0.8 as sufficient_for_training from fused group by 1")
def region_manifest(spark, d):
    return reports.region_manifest(fx.fused(spark, d).withColumn("date", F.to_date("window_ts")))


_CONTEXT = ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "vpd", "max_frp_mw", "average_slope_degrees", "canopy_cover_pct")


def _context(spark, d):
    f = fx.fused(spark, d).withColumns({"temperature_2m": F.col("mean_frp") / 10, "relative_humidity_2m": F.col("max_confidence"), "wind_speed_10m": F.col("median_frp") / 5, "vpd": F.col("latitude") / 20})
    return reports.report_context(f, ["window_ts", "grid_id"])


@query(_U + f""", last as (select mean_frp/10 as temperature_2m, max_confidence as relative_humidity_2m, median_frp/5 as wind_speed_10m, latitude/20 as vpd from fused order by window_ts desc, grid_id desc limit 1)
 select {num(*_CONTEXT)}, active_fire_cells from last, (select sum(active_fire_count)::bigint as active_fire_cells, max(mean_frp) as max_frp_mw, avg(slope_degrees) as average_slope_degrees, avg(canopy_cover_pct) as canopy_cover_pct from fused)""")
def report_context(spark, d):
    return tidy(_context(spark, d))


@query("with c as (" + ORACLES["report_context"] + """) select printf(E'Weather: %.1f C, %.0f %% humidity, wind %.1f km/h, VPD %.2f kPa\nFires: %d detections, largest mean FRP %.1f MW\nTerrain: slope %.1f degrees, canopy %.1f %%',
 round(temperature_2m, 1), round(relative_humidity_2m, 0), round(wind_speed_10m, 1), round(vpd, 2), active_fire_cells, round(max_frp_mw, 1), round(average_slope_degrees, 1), round(canopy_cover_pct, 1)) as context from c""")
def report_text(spark, d):
    return reports.context_text(_context(spark, d))


_RASTER = fx.GRID + """, o as (select region, min(latitude) as la, min(longitude) as lo, avg(latitude) as m from grid group by 1),
 pix as (select grid_id, region, latitude, longitude, floor((latitude-la)/(22.0::double/111))::bigint as row, floor((longitude-lo)/(22.0::double/(111*cos(radians(m)))))::bigint as col from grid join o using (region))"""


def _raster(spark, d):
    return export.raster_index(fx.cells(spark, d), 22.0, ["region"])


@query("with " + fx.DETECTIONS + _RASTER + " select grid_id, region, row, col from pix")
def raster_index(spark, d):
    return _raster(spark, d).select("grid_id", "region", "row", "col")


@query("with " + fx.DETECTIONS + _RASTER + f" select region, row, col, {num('latitude', 'longitude')} from (select region, row, col, arg_max(latitude, grid_id)::float as latitude, arg_max(longitude, grid_id)::float as longitude from pix group by all)")
def spatial_grid(spark, d):
    return tidy(export.spatial_grid(_raster(spark, d), ["latitude", "ndvi", "longitude"], ["region"]))


@query("with " + fx.DETECTIONS + _RASTER + ", px as (select region, row, col, max(grid_id) as g from pix group by all) select a.region, a.g as source, b.g as target, 1.0::double as weight from px a join px b on a.region = b.region and abs(a.row-b.row) <= 1 and abs(a.col-b.col) <= 1 and a.g != b.g")
def adjacency(spark, d):
    return export.adjacency(_raster(spark, d), ["region"])


_CALENDAR = "calendar as (select unnest(generate_series(min(window_ts), max(window_ts), interval 6 hour)) as window_ts from detections)"


def _calendar(spark, d):
    return reports.calendar_of(fx.detections(spark, d), "window_ts")


@query("with " + fx.DETECTIONS + "," + _CALENDAR + f" select {ts('window_ts')} from calendar")
def backfill_calendar(spark, d):
    return tidy(_calendar(spark, d))


@query("with " + fx.DETECTIONS + "," + _CALENDAR + f""" select {ts('window_ts')}, case when window_ts in (select window_ts from detections where frp = (select max(frp) from detections)) then 'failed' else 'processed' end as status,
 case when window_ts in (select window_ts from detections where frp = (select max(frp) from detections)) then 0 else (select count(*) from detections d where d.window_ts = c.window_ts) end as n from calendar c""")
def backfill_ledger(spark, d):
    """Windows written in one job; those that fail are found, the others stay. A window with the strongest detection fails here."""
    rows = fx.detections(spark, d)
    top = rows.agg(F.max("frp").alias("top"))  # one row
    path = new_path(spark)

    def build(windows):
        inside = rows.join(F.broadcast(windows), "window_ts").crossJoin(F.broadcast(top))
        checked = F.when(F.col("frp") == F.col("top"), F.raise_error(F.lit("a detection is out of range"))).otherwise(F.lit(1))
        return inside.withColumn("one", checked).groupBy("window_ts").agg(F.sum("one").alias("n"))

    backfill.backfill(spark, _calendar(spark, d), build, path)
    written = io.read_features(spark, f"{path}/data").select("window_ts", "n")
    return tidy(backfill.ledger(spark, path).join(written, "window_ts", "left").select("window_ts", "status", F.coalesce("n", F.lit(0)).alias("n")))


@query(_U + " select count(*) as row_count, false as passed, 1 as issue_count, " + ", ".join(f"round(avg(({c} is null)::int), 9) as {c}" for c in _COLUMNS) + " from fused")
def stats_summary(spark, d):
    """Row count and null rates of a table, taken by the job that writes it."""
    path = new_path(spark)
    told = backfill.write_with_statistics(fx.fused(spark, d), lambda df: df.write.parquet(path), _COLUMNS, issues=["one"])
    rates = [F.round(F.lit(told["column_null_rates"][c]), 9).alias(c) for c in _COLUMNS]
    return spark.range(1).select(F.lit(told["row_count"]).cast("long").alias("row_count"), F.lit(told["passed"]).alias("passed"), F.lit(told["issue_count"]).alias("issue_count"), *rates)


@query("with " + fx.DETECTIONS + f" select {ts('window_ts')} from (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-02-05', interval 6 hour)) as window_ts) c where window_ts not in (select window_ts from detections where region = 'texas')", also="backfill_pending_all")
def backfill_pending(spark, d):
    return tidy(reports.backfill_pending(reports.backfill_calendar(spark, "2024-01-01 00:00:00", "2024-02-05 00:00:00"), fx.detections(spark, d).filter("region = 'texas'")))


@query("with " + fx.DETECTIONS + fx.GRID + f" select grid_id, {num('elevation_m', 'slope_degrees', 'aspect_degrees', 'canopy_cover_pct')} from (select grid_id, round_even(1000*abs(sin(radians(latitude))),2) as elevation_m, round_even(30*abs(cos(radians(longitude))),2) as slope_degrees, round_even(((longitude+360)%360+360)%360,2) as aspect_degrees, 0.0 as canopy_cover_pct from grid)")
def static_terrain(spark, d):
    return tidy(parsers.static_terrain(fx.cells(spark, d)).drop("fuel_model_fbfm40", "vegetation_type"))


@query("""select event_id as seq, (event_id % 7 = 1)::int + (event_id % 11 = 2)::int + (event_id % 13 = 3)::int + (event_id % 5 = 4)::int as n_issues from events""")
def telemetry_validate(spark, d):
    i = F.col("event_id")
    e = fx.table(spark, d, "events").select(
        i.alias("seq"),
        F.to_json(F.struct(
            F.when(i % 13 == 3, "rumour").otherwise("drone").alias("source_type"), F.when(i % 5 == 4, 9).otherwise(1).alias("priority"), F.when(i % 7 != 1, F.lit(34.5)).alias("latitude"), F.lit(-118.0).alias("longitude"),
            F.lit("2024-01-01T00:00:00").alias("timestamp"), F.when(i % 11 == 2, 140.0).otherwise(80.0).alias("confidence"),
        )).alias("payload"),
    )
    return parsers.telemetry(e).select("seq", F.size("issues").alias("n_issues"))


@query("select user_id::varchar as grid_id, hour, temperature_2m, vpd from (select user_id, unnest(range(3)) as hour, unnest([value, value+1, null]) as temperature_2m, unnest([1.5::double, null, null]) as vpd from events)", also="openmeteo_explode_all")
def openmeteo_explode(spark, d):
    v = F.col("value")
    e = fx.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("grid_id"),
        F.to_json(F.struct(F.struct(F.array(*[F.lit(f"2024-01-01T0{h}:00") for h in range(3)]).alias("time"), F.array(v, v + 1).alias("temperature_2m"), F.array(F.lit(1.5)).alias("vapor_pressure_deficit")).alias("hourly"))).alias("payload"),
    )
    return tidy(parsers.hourly_weather(e).select("grid_id", F.hour("timestamp").cast("long").alias("hour"), "temperature_2m", "vpd"))


@query("select event_id::varchar as grid_id, k::int as \"at\", " + num("temperature_2m", "wind_speed_10m", "wind_direction_10m") + """ from (select event_id, unnest(range(2)) as k, unnest([round_even(((event_id%100)-32)*5.0::double/9, 1), round_even(((event_id%100)+1-32)*5.0::double/9, 1)]) as temperature_2m,
 unnest([round_even((10+event_id%7)::double/2*1.60934::double, 1), round_even((5+5)::double/2*1.60934::double, 1)]) as wind_speed_10m, unnest([45.0, null]) as wind_direction_10m from events)""", also="nws_parse_all")
def nws_parse(spark, d):
    i = F.col("event_id")
    period = lambda t, wind, way: F.struct(F.lit("2024-01-01T00:00:00").alias("startTime"), t.cast("double").alias("temperature"), wind.alias("windSpeed"), F.lit(way).alias("windDirection"))
    e = fx.table(spark, d, "events").select(i.cast("string").alias("grid_id"), F.to_json(F.struct(F.array(period(i % 100, F.concat(F.lit("10 to "), i % 7, F.lit(" mph")), "NE"), period(i % 100 + 1, F.lit("5 mph"), "??")).alias("periods"))).alias("payload"))
    return tidy(parsers.period_weather(e).select("grid_id", "at", "temperature_2m", "wind_speed_10m", "wind_direction_10m"))
