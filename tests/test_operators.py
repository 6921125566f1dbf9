"""Hand-computed cases."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hexfeat.functions import grid, scalar
from hexfeat.operators import anomaly, bias, cells, clean, export, fire, fuse, gates, priority, quality, reports, weather
from hexfeat.registry import Registry
from hexfeat.sources import parsers

T0 = dt.datetime(2024, 8, 1)


def hours(spark, rain=(), temp=(), wind=()):
    n = max(map(len, (rain, temp, wind)))
    pick = lambda xs, i: xs[i] if i < len(xs) else None
    rows = [("c", T0 + dt.timedelta(hours=i), pick(temp, i), 50.0, pick(wind, i), 0.0, pick(rain, i), 0.2, 1.0, i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "grid_id string, timestamp timestamp_ntz, temperature_2m double, relative_humidity_2m double, wind_speed_10m double, wind_direction_10m double, precipitation double, soil_moisture_0_to_7cm double, vpd double, data_quality_flag int")


def test_weather_sums_and_means(spark):
    out = weather.weather_aggregate(hours(spark, rain=(0.0, 1.5, 2.3, 0.0, 0.8, 1.2), temp=(20.0, None, 40.0), wind=(10.0, 20.0, 30.0)), ["grid_id"]).first()
    assert out.precipitation == pytest.approx(5.8) and out.temperature_2m == 30 and out.cumulative_wind_run_24h == 60
    assert out.days_since_last_precipitation == 0 and out.data_quality_flag == 0


def test_days_without_rain(spark):
    days = lambda rain: weather.weather_aggregate(hours(spark, rain=rain), ["grid_id"]).first().days_since_last_precipitation
    assert days((0.5, 2.1)) == 0
    assert days((0.0,) * 24) == 1
    assert days((None,) * 5 + (None,)) is None


def test_drought_rises_with_heat_and_falls_with_moisture(spark):
    rows = spark.createDataFrame([(0.02, 42.0, 80.0), (0.45, 8.0, 0.0), (None, None, None)], "s double, t double, d double")
    hot, wet, none = [r[0] for r in rows.select(weather.drought_index(F.col("s"), F.col("t"), F.col("d"))).collect()]
    assert 0 <= wet < hot <= 1 and none == pytest.approx(0.5)


def test_window_has_both_ends(spark):
    windows = spark.createDataFrame([(T0 + dt.timedelta(hours=6 * k),) for k in range(5)], "window_ts timestamp_ntz")
    out = {r.window_ts: r.precipitation for r in weather.weather_window(hours(spark, rain=(1.0,) * 7), windows, 6, ["grid_id"]).collect()}
    assert out == {T0: 1.0, T0 + dt.timedelta(hours=6): 7.0, T0 + dt.timedelta(hours=12): 1.0}


def test_circular_mean(spark):
    rows = spark.createDataFrame([(350.0,), (10.0,), (None,)], "d double")
    assert rows.agg(scalar.circular_mean("d")).first()[0] % 360 == pytest.approx(0, abs=1e-9)
    assert rows.filter("d is null").agg(scalar.circular_mean("d")).first()[0] is None


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(scalar.wind_speed_kmh(F.lit(10.0), F.lit(0.0))) == 36
    assert get(scalar.wind_direction(F.lit(0.0), F.lit(-10.0))) == 0 and get(scalar.wind_direction(F.lit(10.0), F.lit(0.0))) == 270
    assert get(scalar.vapour_pressure_deficit(F.lit(25.0), F.lit(100.0))) == 0
    assert get(scalar.celsius(F.lit(50.0))) == 10
    assert get(scalar.mph_to_kmh(F.lit("10 to 15 mph"))) == 20.1 and get(scalar.mph_to_kmh(F.lit("calm"))) is None
    assert get(scalar.compass_degrees(F.lit("sw"))) == 225 and get(scalar.compass_degrees(F.lit("x"))) is None
    assert 550 < get(scalar.haversine_km(F.lit(34.05), F.lit(-118.24), F.lit(37.77), F.lit(-122.42))) < 570
    assert get(scalar.confidence(F.lit(" Nominal "))) == 60 and get(scalar.confidence(F.lit("77"))) == 77 and get(scalar.confidence(F.lit("?"))) is None
    assert get(scalar.forecast_key(F.lit("2026-08-15 18:00:00").cast("timestamp"))) == "hrrr.20260815/conus/hrrr.t18z.wrfsfcf00.grib2"
    assert get(scalar.scan_time(F.lit("OR_s20240321830_e1.nc"))) == dt.datetime(2024, 2, 1, 18, 30)
    assert get(scalar.acquisition_time(F.lit("2024-01-02"), F.lit("5"))) == dt.datetime(2024, 1, 2, 0, 5)


def test_clean_and_clip(spark):
    rows = spark.createDataFrame([(1.0, 1.0, "h", float(i)) for i in range(200)] + [(None, 1.0, "l", 5.0), (1.0, 1.0, "x", None), (1.0, 1.0, "l", -5.0)], "latitude double, longitude double, confidence string, frp double")
    out = clean.clip_frp(clean.clean_detections(rows), [])
    assert out.count() == 202
    a = out.agg(F.max("frp"), F.min("frp"), F.count("frp")).first()
    assert 190 < a[0] < 199 and a[1] == 0 and a[2] == 201
    assert clean.validate_raw(rows.filter("false")).first().valid


def test_fire_aggregate_counts_all_sensors(spark):
    rows = spark.createDataFrame([("c", 1.0, 10.0, 30.0), ("c", 1.0, 20.0, 90.0), ("d", 1.0, None, None)], "grid_id string, latitude double, frp double, confidence double")
    out = {r.grid_id: r for r in fire.aggregate_fire(rows, ["grid_id"]).collect()}
    assert (out["c"].active_fire_count, out["c"].mean_frp, out["c"].max_confidence) == (2, 15, 90)
    assert (out["d"].active_fire_count, out["d"].mean_frp, out["d"].max_confidence) == (1, 0, 0)


def test_hex_disks_and_rounding(spark):
    rows = spark.createDataFrame([(34.0, -118.0), (30.1, -100.2), (36.7, -121.3)], "latitude double, longitude double")
    q, r = grid.axial(F.col("latitude"), F.col("longitude"), 5)
    lat, lon = grid.centroid(q, r, 5)
    got = rows.select("*", grid.cell_of(F.col("latitude"), F.col("longitude"), 5).alias("a"), grid.cell_of(lat, lon, 5).alias("b"), F.size(grid.disk(q, r, 2)).alias("n"), F.size(grid.boundary(q, r, 5)).alias("c")).collect()
    assert all(x.a == x.b and x.n == 19 and x.c == 6 for x in got)
    with pytest.raises(ValueError):
        grid.level_of(33)
    assert grid.area_km2(2) > grid.area_km2(5) > grid.area_km2(7)


def test_box_prune_and_focal(spark):
    box = cells.box_cells(spark, {"a": (-104.0, 30.0, -102.0, 32.0), "b": (-103.0, 31.0, -101.0, 33.0)}, 5)
    assert box.count() == box.select("grid_id").distinct().count() > 30
    water = box.select("grid_id", F.lit(98).alias("fuel"))
    assert cells.prune_cells(box, water, 5).count() == 0
    farmland = box.select("grid_id", F.lit(93).alias("fuel"))
    assert cells.prune_cells(box, farmland, 5).count() == box.count()
    one = box.limit(1).select("grid_id")
    focal = cells.focal_grid(one, 5, 5)
    assert focal.count() == 91 and focal.filter("cell_type = 'fire' and ring_distance = 0").count() == 1


def test_fuse_lag_and_priority(spark):
    reg = Registry()
    w0, w1 = T0, T0 + dt.timedelta(hours=6)
    panel = spark.createDataFrame([(c, "ca", 34.0 + i * 0.01, -118.0, w) for i, c in enumerate("ab") for w in (w0, w1)], "grid_id string, region string, latitude double, longitude double, window_ts timestamp_ntz")
    seen = spark.createDataFrame([("a", w0, 3, 10.0, 9.0, 80.0, 1)], "grid_id string, window_ts timestamp_ntz, active_fire_count int, mean_frp double, median_frp double, max_confidence double, fire_detected_binary int")
    fused = fuse.fuse_features(panel, seen, None, None, reg)
    assert fused.count() == 4 and fused.columns[: len(reg.names())] == reg.names()
    assert fused.filter("grid_id = 'b'").agg(F.sum("active_fire_count"), F.max("nearest_fire_distance_km")).first()[:] == (0, -1.0)
    lagged = {(r.grid_id, r.window_ts): (r.active_fire_count, r.fire_detected_binary) for r in fuse.temporal_lag(fused, fused, reg, ["grid_id", "window_ts"], F.make_dt_interval(hours=F.lit(6))).collect()}
    assert lagged[("a", w0)] == (0, 1) and lagged[("a", w1)] == (3, 0)
    truth = spark.createDataFrame([(1, 34.005, -118.0, w0, 15, 300.0), (2, 34.005, -118.0, w0, 99, None), (3, 34.005, -118.0, w0 - dt.timedelta(hours=29), 1, 1.0), (4, 35.0, -118.0, w0, 7, 7.0)], "seq long, latitude double, longitude double, timestamp timestamp_ntz, active_fire_count int, mean_frp double")
    told = {(r.grid_id, r.window_ts): r for r in priority.priority_override(fused, truth).collect()}
    assert told[("a", w0)].active_fire_count == 99 and told[("b", w0)].mean_frp == 300 and told[("b", w0)].data_source_priority == 1
    assert priority.priority_override(fused, None).filter("data_source_priority = 2").count() == 4


def test_gates(spark):
    q, r = 0, 0
    cell = lambda a, b: f"5_{a}_{b}"
    rows = spark.createDataFrame([("s", cell(0, 0)), ("s", cell(1, 0)), ("s", cell(0, 1)), ("s", cell(9, 9))], "scan string, grid_id string")
    assert {x.grid_id for x in gates.gate1_spatial(rows, ["scan"], 5).collect()} == {cell(0, 0), cell(1, 0), cell(0, 1)}
    assert gates.gate2_temporal(rows, rows.filter("grid_id = '5_9_9'"), ["scan"]).count() == 1
    ref = spark.createDataFrame([("s", cell(8, 9), 5.0)], "scan string, grid_id string, frp double")
    assert [x.grid_id for x in gates.gate3_cross_reference(rows, ref, ["scan"], 5).collect()] == [cell(9, 9)]
    assert gates.gate3_cross_reference(rows, ref.filter("false"), ["scan"], 5).count() == 4
    at = spark.createDataFrame([("x", 34.0, -118.0), ("y", 35.0, -118.0)], "grid_id string, latitude double, longitude double")
    src = spark.createDataFrame([(34.01, -118.0, None), (None, 1.0, 5.0)], "s_lat double, s_lon double, radius_km double")
    assert [x.grid_id for x in gates.gate4_industrial(at, src).collect()] == ["y"]


def test_moments_merge_to_the_whole(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("half"), (F.sin("id") * 5 + 30).alias("v"))
    a, b = (anomaly.moments(rows.filter(f"half = {k}"), ["v"], []) for k in (0, 1))
    got = anomaly.merge_moments(a, b, ["feature"]).first()
    want = rows.agg(F.avg("v"), F.stddev_samp("v")).first()
    assert got["mean"] == pytest.approx(want[0]) and got["std"] == pytest.approx(want[1]) and got.n == 1000


def test_zscore_limits_by_season(spark):
    base = spark.createDataFrame([("v", s, 5000, 0.0, 1.0) for s in ("fire_season", "off_season")] + [("w", "off_season", 499, 0.0, 1.0)], "feature string, season string, n long, mean double, std double")
    rows = spark.createDataFrame([(s, v, 9.0) for s, v in (("fire_season", 3.9), ("fire_season", 4.1), ("off_season", 3.4), ("off_season", 3.6))] + [(s, 0.0, 0.0) for s in ("fire_season", "off_season") for _ in range(10)], "season string, v double, w double")
    got = {(r.feature, r.season): r.n_anomalies for r in anomaly.zscore_anomalies(rows, base, ["v", "w"]).collect()}
    assert got == {("v", "fire_season"): 1, ("v", "off_season"): 1}


def test_kl_is_zero_for_equal_and_positive_for_disjoint(spark):
    rows = spark.range(400).select((F.col("id") % 2).cast("string").alias("same"), F.when(F.col("id") < 200, "low").otherwise("high").alias("apart"), (F.floor(F.col("id") / 2)).cast("double").alias("v"))
    out = {(r.slice_dimension, r.slice_value): r.kl for r in bias.kl_divergence(rows, ["v"], {"same": "same", "apart": "apart"}).collect()}
    assert out[("same", "0")] == pytest.approx(0, abs=1e-6) and out[("apart", "low")] > 0.5
    shares = bias.bias_slices(rows.withColumn("y", F.lit(0)), "y", {"same": "same"}).agg(F.sum("pct_of_total")).first()[0]
    assert shares == pytest.approx(100)


def test_validation_finds_faults(spark):
    rows = spark.createDataFrame([("a", 999.0), (None, 20.0)], "grid_id string, temperature_2m double")
    bad = {(r.expectation, r.column_name) for r in quality.validate_schema(rows, Registry()).filter("not success").collect()}
    assert ("range", "temperature_2m") in bad and ("not_null", "grid_id") in bad and ("exists", "region") in bad


def test_raster_and_adjacency(spark):
    rows = spark.createDataFrame([(f"c{i}{j}", 34 + 0.2 * i, -118 + 0.25 * j) for i in range(2) for j in range(2)], "grid_id string, latitude double, longitude double")
    indexed = export.raster_index(rows, 22.0)
    edges = {(r.source, r.target) for r in export.adjacency(indexed).collect()}
    assert len(edges) == 12 and all((b, a) in edges for a, b in edges)
    assert export.dense(export.spatial_grid(indexed, ["latitude"]), ["latitude"]).shape == (2, 2, 1)
    with pytest.raises(ValueError):
        export.spatial_grid(indexed, ["nothing"])


def test_calendar_and_telemetry(spark):
    assert reports.backfill_calendar(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00").count() == 5
    good = '{"source_type":"drone","priority":1,"latitude":34,"longitude":-118,"timestamp":"2024-01-01T00:00:00","confidence":80}'
    rows = parsers.telemetry(spark.createDataFrame([(1, good), (2, good.replace('"latitude":34,', "")), (3, good.replace("80", "140")), (4, "no json")], "seq long, payload string"))
    assert [r.seq for r in rows.filter(F.size("issues") == 0).collect()] == [1]
    assert parsers.ground_truth(rows).first().fire_detected_binary == 1


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0, 5000), st.integers(0, 500)), min_size=1, max_size=20))
def test_counts_are_conserved(spark, values):
    rows = spark.createDataFrame([(i, 32 + i * 0.3, -120 + i * 0.3, float(f), 50.0) for i, (f, _) in enumerate(values)], "seq int, latitude double, longitude double, frp double, confidence double")
    for level in (2, 5):
        out = fire.aggregate_fire(rows.withColumn("grid_id", grid.cell_of(F.col("latitude"), F.col("longitude"), level)), ["grid_id"])
        assert out.agg(F.sum("active_fire_count")).first()[0] == len(values)
    assert not math.isnan(rows.agg(F.avg("frp")).first()[0])


def test_seasons_are_sliced(spark, monkeypatch):
    """Fires of one season only: its disparity, divergence, null rates and findings appear."""
    from hexfeat.plans import quality_queries as q

    rows = [(f"2024-{1 if i < 60 else 8:02d}-01 00:00:00", "texas", 0, 101, 10.0 + i % 5 if i < 60 else 90.0 + i % 5, 50.0, None if i % 4 == 0 else 100.0) for i in range(100)]
    fused = spark.createDataFrame(rows, "t string, region string, data_quality_flag int, fuel_model_fbfm40 int, mean_frp double, max_confidence double, elevation_m double").withColumn("window_ts", F.col("t").cast("timestamp_ntz"))
    monkeypatch.setattr(q.fx, "fused", lambda *_: fused)
    slices = {(r.slice_dimension, r.slice_value): r for r in q.QUERIES["bias_slices_all"](spark, "").collect()}
    assert slices["fire_season", "fire_season"].fire_rate_biased and slices["fire_season", "off_season"].row_count == 60
    kl = {(r.slice_dimension, r.slice_value, r.feature): r.kl for r in q.QUERIES["kl_divergence_all"](spark, "").collect()}
    assert kl["fire_season", "fire_season", "mean_frp"] > 0.1
    rates = {(r.slice_dimension, r.slice_value, r.feature): r.null_rate for r in q.QUERIES["slice_null_rates"](spark, "").collect()}
    assert rates["fire_season", "off_season", "elevation_m"] == 0.25 and rates["geographic_region", "texas", "mean_frp"] == 0
    assert any(r.slice_dimension == "fire_season" for r in q.QUERIES["findings_text"](spark, "").collect())


def test_industrial_sources_of_any_radius(spark):
    """Cells far within a large radius go, cells beyond it stay, also where degrees of longitude are short."""
    sources = spark.createDataFrame([(35.0, -100.0, 300.0), (60.0, 10.0, None)], "s_lat double, s_lon double, radius_km double")
    cells_ = spark.createDataFrame([("in", 37.5, -100.0), ("east", 35.0, -96.8), ("out", 38.0, -100.0), ("near", 60.0, 10.03), ("far", 60.0, 10.05)], "grid_id string, latitude double, longitude double")
    assert {r.grid_id for r in gates.gate4_industrial(cells_, sources).collect()} == {"out", "far"}
    assert gates.gate4_industrial(cells_, sources.filter("false")).count() == 5
