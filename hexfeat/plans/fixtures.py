"""The star-schema tables seen as hazard-monitoring tables: the same views in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid, scalar
from ..operators import clean, fire

LEVEL = 5
HOURS = 6
# Fixed boxes of the two regions: south-west corners and how many steps of a quarter degree are used.
SQL_CELL = f"""
 (with p as (select *, (longitude*{grid.SHRINK!r}*{grid.ROOT3 / 3!r} - latitude/3)/{grid.SIZE[LEVEL]!r} as fq, (latitude*2/3)/{grid.SIZE[LEVEL]!r} as fr from {{0}}),
  c as (select *, floor(fq+0.5) as rq, floor(fr+0.5) as rr, floor(-fq-fr+0.5) as rs from p),
  d as (select *, abs(rq-fq) as dq, abs(rr-fr) as dr, abs(rs-(-fq-fr)) as ds from c)
  select * exclude (fq,fr,rq,rr,rs,dq,dr,ds), cast(case when dq>dr and dq>ds then -rr-rs else rq end as bigint) as q, cast(case when dq>dr and dq>ds then rr when dr>ds then -rq-rs else rr end as bigint) as r from d)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event: a detection at a place that follows from the user."""
    u = F.col("user_id")
    ca = u % 2 == 0
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("cell_"), u).alias("grid_id"), F.when(ca, "california").otherwise("texas").alias("region"),
        F.when(ca, F.lit(32.53) + (u % 38) * F.lit(0.25)).otherwise(F.lit(25.84) + (u % 42) * F.lit(0.25)).alias("latitude"),
        F.when(ca, F.lit(-124.48) + ((u * 7) % 41) * F.lit(0.25)).otherwise(F.lit(-106.65) + ((u * 7) % 52) * F.lit(0.25)).alias("longitude"),
        F.col("value").alias("frp"), F.when(F.col("event_type") == "error", "l").when(F.col("event_type") == "view", "n").when(F.col("event_type") == "click", "h").otherwise(F.get_json_object("props", "$.k")).alias("confidence"),
        F.col("event_type").alias("sensor_source"), F.col("ts").alias("acq_ts"), scalar.window_start(F.col("ts"), HOURS).alias("window_ts"),
    )


DETECTIONS = """
detections as (
 select event_id as seq, 'cell_'||user_id as grid_id, case when user_id%2=0 then 'california' else 'texas' end as region,
  case when user_id%2=0 then 32.53::double+(user_id%38)*0.25::double else 25.84::double+(user_id%42)*0.25::double end as latitude,
  case when user_id%2=0 then -124.48::double+((user_id*7)%41)*0.25::double else -106.65::double+((user_id*7)%52)*0.25::double end as longitude,
  value as frp, case event_type when 'error' then 'l' when 'view' then 'n' when 'click' then 'h' else json_extract_string(props,'$.k') end as confidence,
  event_type as sensor_source, ts as acq_ts, date_trunc('day', ts)::timestamp + to_hours((6*(hour(ts)//6))::int) as window_ts
 from events)"""

CLEANED = (
    DETECTIONS
    + """,
cleaned as (
 select seq, grid_id, region, latitude, longitude, frp, acq_ts, window_ts, sensor_source, coalesce(case lower(trim(confidence)) when 'l' then 30.0 when 'n' then 60.0 when 'h' then 90.0 end::double, try_cast(confidence as double)) as confidence
 from detections where latitude is not null and longitude is not null),
tops as (select region, window_ts, quantile_cont(frp, 0.995) as top from cleaned group by all),
clipped as (select c.* exclude (frp), greatest(least(frp, top), 0) as frp from cleaned c join tops using (region, window_ts)),
fire as (
 select grid_id, region, window_ts, count(latitude)::int as active_fire_count, coalesce(avg(frp),0) as mean_frp, coalesce(median(frp),0) as median_frp, coalesce(max(confidence),0) as max_confidence, 1 as fire_detected_binary
 from clipped group by all)"""
)


def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clip_frp(clean.clean_detections(detections(spark, sf_dir)), ["region", "window_ts"])


def fire_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fire.aggregate_fire(clipped(spark, sf_dir), ["grid_id", "region", "window_ts"])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid: one row for each place."""
    return detections(spark, sf_dir).select("grid_id", "region", "latitude", "longitude").distinct()


GRID = ", grid as (select distinct grid_id, region, latitude, longitude from detections)"


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line: an hour of weather of the supplier's cell."""
    t = F.col("l_quantity") * F.lit(0.9)
    rh = F.col("l_discount") * F.lit(1000.0)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("cell_"), F.col("l_suppkey")).alias("grid_id"), (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("timestamp"),
        t.alias("temperature_2m"), rh.alias("relative_humidity_2m"), (F.col("l_extendedprice") / 1000).alias("wind_speed_10m"), (F.col("l_partkey") % 360).cast("double").alias("wind_direction_10m"),
        F.when(F.col("l_linenumber") != 7, F.col("l_tax") * F.lit(20.0)).alias("precipitation"), (F.col("l_quantity") / 100).alias("soil_moisture_0_to_7cm"), scalar.vapour_pressure_deficit(t, rh).alias("vpd"),
        F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "N", 3).otherwise(0).alias("data_quality_flag"),
    )


WEATHER = """
weather_hourly as (
 select 'cell_'||l_suppkey as grid_id, l_shipdate::timestamp + to_hours(l_linenumber::int) as timestamp, l_quantity*0.9::double as temperature_2m, l_discount*1000.0::double as relative_humidity_2m,
  l_extendedprice/1000 as wind_speed_10m, (l_partkey%360)::double as wind_direction_10m, case when l_linenumber != 7 then l_tax*20.0::double end as precipitation, l_quantity/100 as soil_moisture_0_to_7cm,
  round_even(greatest(0, 0.6108::double*exp(17.27::double*(l_quantity*0.9::double)/((l_quantity*0.9::double)+237.3::double))*(1-least(greatest(l_discount*1000.0::double,0),100)/100)), 4) as vpd,
  case l_returnflag when 'R' then 2 when 'N' then 3 else 0 end as data_quality_flag
 from lineitem)"""


def static_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part: fuel and terrain of a cell."""
    codes = F.array(*[F.lit(c) for c in FUELS])
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("cell_"), F.col("p_partkey")).alias("grid_id"), F.element_at(codes, (F.col("p_size") % len(FUELS) + 1).cast("int")).cast("smallint").alias("fuel_model_fbfm40"),
        F.col("p_retailprice").alias("elevation_m"), (F.col("p_size") * 1.5).alias("slope_degrees"), (F.col("p_size") * 2.0).alias("canopy_cover_pct"),
    )


FUELS = (91, 93, 99, 101, 122, 145, 163, 185, 202, 999)
STATIC = f"""
static_features as (
 select 'cell_'||p_partkey as grid_id, (list_value({", ".join(map(str, FUELS))})[p_size % {len(FUELS)} + 1])::smallint as fuel_model_fbfm40, p_retailprice as elevation_m, p_size*1.5::double as slope_degrees, p_size*2.0::double as canopy_cover_pct
 from part)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with fire of each window, beside terrain and a quality flag that follows from the cell."""
    f = fire_features(spark, sf_dir).join(cells(spark, sf_dir), ["grid_id", "region"])
    return f.join(static_features(spark, sf_dir), "grid_id", "left").withColumn("data_quality_flag", (F.col("active_fire_count") % 5).cast("int"))


FUSED = (
    CLEANED
    + GRID
    + ","
    + STATIC
    + """,
fused as (
 select f.*, g.latitude, g.longitude, s.* exclude (grid_id), (active_fire_count % 5)::int as data_quality_flag
 from fire f join grid g using (grid_id, region) left join static_features s on s.grid_id = f.grid_id)"""
)


def hex_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hexagons with fire of each region and window, with their largest frp."""
    return hexagons(detections(spark, sf_dir), LEVEL)


def hexagons(detections: DataFrame, level: int) -> DataFrame:
    q, r = grid.axial(F.col("latitude"), F.col("longitude"), level)
    placed = detections.select("region", "window_ts", "frp", q.alias("q"), r.alias("r"))
    return placed.groupBy("region", "window_ts", "q", "r").agg(F.max("frp").alias("frp")).withColumn("grid_id", grid.cell_id(F.col("q"), F.col("r"), level))


HEX = DETECTIONS + ", placed as (select * from" + SQL_CELL.format("detections") + f"), hex as (select region, window_ts, q, r, '{LEVEL}_'||q||'_'||r as grid_id, max(frp) as frp from placed group by all)"
