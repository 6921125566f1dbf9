"""Hourly weather series to cell features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.scalar import circular_mean
from . import near

#: Weights of the drought proxy: dryness of soil, heat, days without rain.
DROUGHT = (0.40, 0.25, 0.35)
WET_MM = 1.0


def days_since_precip() -> Column:
    """Aggregate over a cell's hours: 0 if it rained, else the span of the series in days, at least 1; null if precipitation is unknown throughout the scope (_any_rain false)."""
    wet = F.max(F.when(F.coalesce("precipitation", F.lit(0.0)) >= WET_MM, 1).otherwise(0)) == 1
    hours = F.timestamp_diff("SECOND", F.min("timestamp"), F.max("timestamp")) / 3600
    dry = F.when(F.min("timestamp").isNull(), F.lit(1.0)).otherwise(F.greatest(hours / 24, F.lit(1.0)))
    days = F.least(F.greatest(F.bround(F.when(wet, F.lit(0.0)).otherwise(dry), 0), F.lit(0.0)), F.lit(365.0))
    return F.when(F.max("_any_rain"), days).cast("short")


def wind_run() -> Column:
    return F.sum(F.greatest(F.coalesce("wind_speed_10m", F.lit(0.0)), F.lit(0.0)))


def drought_index(soil: Column, temperature: Column, days: Column) -> Column:
    """In [0, 1], each missing part counted as one half."""
    def share(x: Column, turned: bool = False) -> Column:
        clipped = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))  # these skip nulls, so a null is told apart first
        return F.when(x.isNull(), 0.5).otherwise(1 - clipped if turned else clipped)

    a, b, c = DROUGHT
    return F.least(F.greatest(a * share(soil / 0.5, turned=True) + b * share(temperature / 45.0) + c * share(days / 90.0), F.lit(0.0)), F.lit(1.0))


def with_rain_known(df: DataFrame, scope: list[str]) -> DataFrame:
    """Adds _any_rain: whether any precipitation of the scope is known. scope: columns of one ingested file."""
    known = F.count("precipitation") > 0
    if not scope:
        return df.crossJoin(F.broadcast(df.agg(known.alias("_any_rain"))))  # one row
    return df.join(df.groupBy(*scope).agg(known.alias("_any_rain")), scope)


def weather_aggregate(df: DataFrame, keys: list[str], scope: list[str] | None = None) -> DataFrame:
    """One row by key: means, circular mean of direction, sum of rain, highest index, best flag, and the derived features."""
    out = with_rain_known(df, scope or []).groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "soil_moisture_0_to_7cm", "vpd")],
        circular_mean("wind_direction_10m").alias("wind_direction_10m"), F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precipitation"),
        F.min("data_quality_flag").alias("data_quality_flag"), days_since_precip().alias("days_since_last_precipitation"), wind_run().alias("cumulative_wind_run_24h"),
    )
    return out.withColumn("drought_index_proxy", drought_index(F.col("soil_moisture_0_to_7cm"), F.col("temperature_2m"), F.col("days_since_last_precipitation").cast("double")))


def weather_window(df: DataFrame, windows: DataFrame, hours: int, keys: list[str]) -> DataFrame:
    """Arithmetic means (sum of rain) of the hours in [window - hours, window], both ends included, for each window.

    An hour on a boundary belongs to two windows. The windows that an hour falls into follow from its time (at most
    two, for windows `hours` apart), so the range condition is an equi-join on exploded window starts.
    """
    start = F.floor(F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("timestamp")) / hours).cast("long")
    at = F.explode(F.filter(F.transform(F.array(start, start + 1), lambda k: F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(k * hours).cast("int"))), lambda w: (F.col("timestamp") <= w) & (F.col("timestamp") >= w - F.make_dt_interval(hours=F.lit(hours)))))
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and c not in keys]
    dealt = df.withColumn("window_ts", at).join(F.broadcast(windows.select("window_ts").distinct()), "window_ts", "left_semi")
    return dealt.groupBy(*keys, "window_ts").agg(*[(F.coalesce(F.sum(c), F.lit(0.0)) if c == "precipitation" else F.avg(c)).alias(c) for c in numeric])


def merge_sources(primary: DataFrame, background: DataFrame, key: str = "grid_id") -> DataFrame:
    """All rows of primary, and those of background for cells that primary doesn't have."""
    return primary.unionByName(background.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def forward_fill(df: DataFrame, columns: list[str], keys: list[str], order: str) -> DataFrame:
    """Nulls take the last known value of their key before them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def asof_join(left: DataFrame, right: DataFrame, time: str, values: list[str], seconds: int, on: tuple[str, ...] = ()) -> DataFrame:
    """left with the time (as _time) and values of the newest row of right that is not later and less than so many seconds older.

    Both sides are put behind each other, sorted, and the last known row of right is carried along; times may be as
    irregular as they like. Time is cut into stretches of the tolerance, and right is also dealt to the stretch after its
    own: so even without keys no task holds more than a stretch. Of rows of right at one time the largest counts.
    """
    at = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time)) / (seconds * 1_000_000)).cast("long")
    hit = F.struct(F.col(time).alias("time"), *values)
    hits = right.filter(F.col(time).isNotNull()).select(*on, time, hit.alias("_hit"), F.explode(F.array(at, at + 1)).alias("_stretch"))
    rows = left.withColumn("_stretch", at)
    both = rows.withColumn("_mine", F.lit(True)).unionByName(hits.withColumn("_mine", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(*on, "_stretch").orderBy(time, "_mine", "_hit").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(order)).filter("_mine")
    near = F.timestamp_diff("MICROSECOND", F.col("_hit.time"), F.col(time)) < seconds * 1_000_000
    return found.withColumn("_hit", F.when(near, F.col("_hit"))).select(*left.columns, F.col("_hit.time").alias("_time"), *[F.col(f"_hit.{v}").alias(v) for v in values])


def newest_cycle(times: DataFrame, cycles: DataFrame, tolerance_hours: int = 3) -> DataFrame:
    """For each t the newest published cycle up to t that is less than the tolerance older than t's full hour; null if there is none."""
    found = asof_join(times.select(F.col("t").cast("timestamp_ntz").alias("t")), cycles.select(F.col("cycle").cast("timestamp_ntz").alias("t")), "t", [], (tolerance_hours + 1) * 3600)
    least = F.date_trunc("HOUR", F.col("t")).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(tolerance_hours))
    return found.select("t", F.when(F.col("_time") > least, F.col("_time")).alias("cycle"))


FOCAL_FLAG, STALE_FLAG = 3, 4


def focal_weather(cells: DataFrame, times: DataFrame, fields: DataFrame, background: DataFrame, step: float) -> DataFrame:
    """One row for each t and cell: the newest cycle's gridded fields at the nearest node, else the background's row, else nothing.

    cells: grid_id, latitude, longitude; times: t; fields: cycle, lat, lon, temperature_2m, relative_humidity_2m, u, v,
    precipitation; background: grid_id, t, the weather columns and its flag. Nodes may differ by cycle: those of all
    cycles are one grid, and a cycle without a value at the nearest node counts as failed there. Wind and vapour
    pressure deficit are derived. Flag 3 marks the gridded fields, 4 a row that both sources lack.
    """
    picked = newest_cycle(times, fields.select("cycle").distinct())
    nodes = near.nearest_grid_value(cells, fields.select("lat", "lon").distinct().withColumns({"node_lat": F.col("lat"), "node_lon": F.col("lon")}), ["node_lat", "node_lon"], step)
    wanted = picked.crossJoin(cells.select("grid_id").join(nodes, "grid_id"))  # the result has each pair
    u, v, t, rh = (F.col(c) for c in ("u", "v", "temperature_2m", "relative_humidity_2m"))
    values = fields.select(
        "cycle", F.col("lat").alias("node_lat"), F.col("lon").alias("node_lon"), t, rh, scalar.wind_speed_kmh(u, v).alias("wind_speed_10m"), scalar.wind_direction(u, v).alias("wind_direction_10m"),
        F.col("precipitation"), scalar.vapour_pressure_deficit(t, rh).alias("vpd"), F.lit(FOCAL_FLAG).alias("data_quality_flag"),
    )
    names = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "wind_direction_10m", "precipitation", "vpd", "data_quality_flag"]
    focal = wanted.join(values, ["cycle", "node_lat", "node_lon"]).select("t", "grid_id", "cycle", *names)
    open_ = wanted.join(focal.select("t", "grid_id"), ["t", "grid_id"], "left_anti").select("t", "grid_id")
    rest = open_.join(background.select("t", "grid_id", *names), ["t", "grid_id"], "left").select("t", "grid_id", F.lit(None).cast("timestamp_ntz").alias("cycle"), *names[:-1], F.coalesce("data_quality_flag", F.lit(STALE_FLAG)).alias("data_quality_flag"))
    return focal.unionByName(rest)
