"""Nearest neighbours, as-of joins, percentiles, filled polygons and raster blocks against plain versions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexfeat.functions import grid
from hexfeat.operators import blocks, clean, export, fill, fire, near, priority, weather

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_node_on_scattered_nodes(spark, seed):
    """A dense heap, lone nodes far away, ties, points far from all nodes, and points without a position."""
    rng = random.Random(seed)
    nodes = [(rng.gauss(0, 0.2), rng.gauss(0, 0.2), float(k)) for k in range(150)] + [(rng.uniform(-60, 60), rng.uniform(-60, 60), 1000.0 + k) for k in range(12)] + [(10.0, 10.0, 1.0), (10.0, 12.0, 2.0)]
    points = [(f"p{k}", rng.uniform(-80, 80), rng.uniform(-80, 80)) for k in range(60)] + [(f"d{k}", rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for k in range(60)] + [("tie", 10.0, 11.0), ("none", None, 1.0)]
    got = near.nearest_grid_value(spark.createDataFrame(points, "grid_id string, latitude double, longitude double"), spark.createDataFrame(nodes, "lat double, lon double, v double"), ["v"], 0.1)
    want = {g: None if a is None else min(((b - o) ** 2 + (a - y) ** 2, y, o, v) for y, o, v in nodes)[3] for g, a, b in points}
    assert {r["grid_id"]: r["v"] for r in got.collect()} == want
    none = near.nearest_grid_value(spark.createDataFrame(points, "grid_id string, latitude double, longitude double"), spark.createDataFrame([], "lat double, lon double, v double"), ["v"], 0.1)
    assert none.count() == len(points) and none.filter("v is not null").count() == 0


def _most_rows(spark, since):
    """The most rows that an operator of the queries after the first `since` gave, and the number of queries."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    for i in range(since, runs.size()):
        key = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(key), store.planGraph(key).allNodes()
        for n in (nodes.apply(j) for j in range(nodes.size())):
            for m in (n.metrics().apply(j) for j in range(n.metrics().size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, runs.size()


def test_nearest_node_in_crowds(spark):
    """Points at one place ask once; a crowd in a crowd of nodes and a crowd beside it meet few of them."""
    rng = np.random.default_rng(7)
    nodes = np.concatenate([rng.normal(0, 0.003, (1500, 2)), rng.uniform(-30, 30, (20, 2)), [[5.0, 5.0]] * 300])
    points = np.concatenate([rng.normal(0, 0.003, (700, 2)), rng.normal(0.05, 0.01, (700, 2)), [[0.0, 0.001]] * 600, [[5.0, 5.1]] * 20])
    n = spark.createDataFrame([(*map(float, p), k) for k, p in enumerate(nodes)], "lat double, lon double, v long")
    p = spark.createDataFrame([(f"p{k}", *map(float, p)) for k, p in enumerate(points)] + [("nan", math.nan, 0.0), ("none", None, 0.0)], "grid_id string, latitude double, longitude double")
    odd = spark.createDataFrame([(math.nan, 0.0, -1), (None, 0.0, -2), (math.inf, 0.0, -3)], n.schema)
    since = _most_rows(spark, 10**9)[1]
    got = {r["grid_id"]: r["v"] for r in near.nearest_grid_value(p, n.unionByName(odd), ["v"], 0.5).collect()}
    want = {f"p{k}": min(zip(((nodes - q) ** 2).sum(1), nodes[:, 0], nodes[:, 1], range(len(nodes)), strict=True))[3] for k, q in enumerate(points)}
    assert got == want | {"nan": min(zip(nodes[:, 0], nodes[:, 1], range(len(nodes)), strict=True))[2], "none": None}
    assert 0 < _most_rows(spark, since)[0] < 500_000  # of 2,020 points and 1,820 nodes


def test_nearest_fire_on_scattered_cells(spark):
    rng = random.Random(3)
    cells = {(s, rng.randint(-200, 200), rng.randint(-200, 200)) for s in "ab" for _ in range(40)} | {("a", q, r) for q in range(5) for r in range(5)} | {("lone", 3, 4)}
    got = fire.nearest_fire(spark.createDataFrame(list(cells), "region string, q long, r long"), ["region"], 22.0)

    def steps(a, b):
        return max(abs(a[1] - b[1]), abs(a[2] - b[2]), abs(a[1] - b[1] + a[2] - b[2]))

    want = {c: min((steps(c, o) * 16.5 for o in cells if o != c and o[0] == c[0]), default=-1.0) for c in cells}
    assert {(r["region"], r["q"], r["r"]): r["nearest_fire_distance_km"] for r in got.collect()} == want
    assert fire.nearest_fire(spark.createDataFrame([], "region string, q long, r long"), ["region"], 22.0).count() == 0


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_asof_join_on_irregular_times(spark, keys):
    rng = random.Random(4)
    left = [(rng.choice("ab"), T0 + dt.timedelta(seconds=rng.randint(0, 40_000)), n) for n in range(200)] + [("a", None, -1)]
    right = [(rng.choice("ab"), T0 + dt.timedelta(seconds=rng.choice([rng.randint(0, 4000), rng.randint(20_000, 40_000)])), rng.randint(0, 3)) for _ in range(40)]
    frame = lambda rows, c: spark.createDataFrame(rows, f"k string, t timestamp_ntz, {c} int").repartition(3)
    r = frame(right, "v") if keys else frame(right, "v").drop("k")
    got = {x["n"]: (x["_time"], x["v"]) for x in weather.asof_join(frame(left, "n"), r, "t", ["v"], 3600, keys).collect()}
    for k, t, n in left:
        near_ = [(u, v) for j, u, v in right if t is not None and (not keys or j == k) and u <= t and (t - u).total_seconds() < 3600]
        assert got[n] == (max(near_) if near_ else (None, None))


def test_focal_weather_falls_back(spark):
    """The newest cycle within reach, a node without a value, no cycle at all, and nothing in either source."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    cells = spark.createDataFrame([("a", 34.1, -118.1), ("b", 36.2, -118.1)], "grid_id string, latitude double, longitude double")
    fields = spark.createDataFrame([(at(1), 34.0, -118.0, 20.0, 50.0, 3.0, 4.0, 0.5), (at(2), 34.0, -118.0, 25.0, 50.0, 0.0, -5.0, 0.0), (at(1), 36.0, -118.0, 10.0, 50.0, 0.0, 0.0, 0.0)], "cycle timestamp_ntz, lat double, lon double, temperature_2m double, relative_humidity_2m double, u double, v double, precipitation double")
    back = spark.createDataFrame([("b", at(3), 11.0, 1.0, 2.0, 3.0, 0.0, 0.4, 2), ("a", at(9), 12.0, 1.0, 2.0, 3.0, 0.0, 0.4, 0)], "grid_id string, t timestamp_ntz, temperature_2m double, relative_humidity_2m double, wind_speed_10m double, wind_direction_10m double, precipitation double, vpd double, data_quality_flag int")
    times = spark.createDataFrame([(at(1.5),), (at(3),), (at(9),)], "t timestamp_ntz")
    got = {(r["t"], r["grid_id"]): (r["cycle"], r["temperature_2m"], r["wind_speed_10m"], r["data_quality_flag"]) for r in weather.focal_weather(cells, times, fields, back, 0.25).collect()}
    assert got == {
        (at(1.5), "a"): (at(1), 20.0, 18.0, 3), (at(1.5), "b"): (at(1), 10.0, 0.0, 3), (at(3), "a"): (at(2), 25.0, 18.0, 3),
        (at(3), "b"): (None, 11.0, 2.0, 2), (at(9), "a"): (None, 12.0, 2.0, 0), (at(9), "b"): (None, None, None, 4),
    }


@pytest.mark.parametrize("small", [10, 10_000])
def test_percentiles_are_exact(spark, monkeypatch, small):
    """With brackets and without: ties, few values, nulls, negative values, one value, and a group of nulls only."""
    monkeypatch.setattr(clean, "SMALL", small)
    rng = np.random.default_rng(5)
    groups = {"big": rng.normal(0, 100, 30_000), "ties": rng.integers(0, 3, 5000).astype(float), "few": rng.normal(0, 1, 7), "one": np.array([2.5]), "same": np.full(3000, -4.0)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("nulls", None), ("few", None)]
    shares = [0.0, 0.05, 0.5, 0.95, 0.995, 1.0]
    got = {r["k"]: r for r in clean.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", shares).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert [got[k][f"p{i}"] for i in range(len(shares))] == pytest.approx(np.quantile(v, shares).tolist(), abs=1e-9)


def test_truth_is_joined_by_time(spark):
    """A plan whose join key holds the time, and windows on both sides of the limit of six hours."""
    hour = lambda h: T0 + dt.timedelta(hours=h)
    fused = spark.createDataFrame([("a", hour(6 * k), 34.0, -118.0, 0) for k in range(-2, 5)], "grid_id string, window_ts timestamp_ntz, latitude double, longitude double, active_fire_count int")
    truth = spark.createDataFrame([(1, 34.01, -118.01, hour(6), 7)], "seq long, latitude double, longitude double, timestamp timestamp_ntz, active_fire_count int")
    out = priority.priority_override(fused, truth)
    assert {r["window_ts"]: r["active_fire_count"] for r in out.collect()} == {hour(6 * k): 7 if 0 <= k <= 2 else 0 for k in range(-2, 5)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert any("_t" in line and "_y" in line and "_x" in line for line in plan.split("\n") if "Join Inner" in line)


def _inside(p, ring):
    turns = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)


def _cross(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


@pytest.mark.parametrize("level", [2, 5])
def test_cells_that_a_polygon_touches(spark, level):
    """By corners inside of each other and crossing edges: triangles and boxes, some smaller than a cell, some larger than coarse ones."""
    rng = random.Random(level)
    shapes = {}
    for k in range(14):
        lon, lat, size = rng.uniform(-120, -110), rng.uniform(30, 40), rng.choice([0.02, 0.3, 1.0, 3.0])
        turn = rng.uniform(0, 6)
        n = rng.choice([3, 4, 5])
        shapes[k] = [(lon + size * math.cos(turn + 2 * math.pi * i / n), lat + size * math.sin(turn + 2 * math.pi * i / n)) for i in range(n)]
    frame = spark.createDataFrame([(k, v + v[:1] if k % 2 else v) for k, v in shapes.items()] + [(99, None), (98, [])], "k int, ring array<struct<lon:double,lat:double>>")
    got = {}
    rows = fill.polygon_cells(frame, ["k"], level).collect()
    for r in rows:
        got.setdefault(r["k"], set()).add((r["q"], r["r"]))
    assert len(rows) == sum(map(len, got.values()))  # no cell twice
    s = grid.SIZE[level]
    for k, shape in shapes.items():
        ring = [(lon * grid.SHRINK, lat) for lon, lat in shape]
        want = set()
        r0, r1 = min(y for _, y in ring) / (1.5 * s), max(y for _, y in ring) / (1.5 * s)
        for r in range(math.floor(r0) - 3, math.ceil(r1) + 4):
            q0, q1 = (f(x for x, _ in ring) / (grid.ROOT3 * s) - r / 2 for f in (min, max))
            for q in range(math.floor(q0) - 3, math.ceil(q1) + 4):
                x, y = (q + r / 2) * grid.ROOT3 * s, r * 1.5 * s
                hexagon = [(x + s * math.cos(math.radians(60 * i + 30)), y + s * math.sin(math.radians(60 * i + 30))) for i in range(6)]
                edges = lambda v: list(zip(v, v[1:] + v[:1], strict=True))
                if any(_inside(p, hexagon) for p in ring) or any(_inside(p, ring) for p in hexagon) or any(_cross(*a, *b) for a in edges(ring) for b in edges(hexagon)):
                    want.add((q, r))
        assert got[k] == want


@pytest.mark.parametrize("width,boxes", [(0.7, 400), (60.0, 1)])
def test_polygons_are_dealt_to_all_tasks(spark, width, boxes):
    """Many small boxes in one partition, and one large box: their cells come from several tasks, and few other cells are tried."""
    lat, lon = F.lit(10.0) + F.col("k") % 20, F.lit(-100.0) + F.col("k") / 7
    frame = spark.createDataFrame([(k,) for k in range(boxes)], "k int").coalesce(1).select("k", fill.box(lon, lat, lon + width, lat + width).alias("ring"))
    since = _most_rows(spark, 10**9)[1]
    by_task = [r["count"] for r in fill.polygon_cells(frame, ["k"], 5).groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) == 4 and max(by_task) < 0.6 * sum(by_task)
    assert sum(by_task) <= _most_rows(spark, since)[0] < 2 * sum(by_task)


def test_blocks_hold_the_raster(spark, tmp_path):
    """Blocks written by region, replaced by partition, read back as rows and as the dense array; gaps are NaN."""
    rng = random.Random(6)
    cells = [(region, row, col, rng.random() if row % 3 else None, float(row * 100 + col)) for region in ("ca", "tx") for row in range(0, 150, 2) for col in range(0, 70, 3) if rng.random() < 0.4]
    pixels = spark.createDataFrame(cells, "region string, row long, col long, a double, b double").repartition(4)
    path = str(tmp_path / "blocks")
    blocks.write_blocks(blocks.tensor_blocks(pixels, ["a", "b"], ["region"], 32), path, ["region"])
    blocks.write_blocks(blocks.tensor_blocks(pixels.filter("region = 'tx'"), ["a", "b"], ["region"], 32), path, ["region"])
    for region in ("ca", "tx"):
        whole = export.dense(pixels.filter(F.col("region") == region), ["a", "b"])
        np.testing.assert_array_equal(blocks.read_raster(spark, path, f"region = '{region}'"), whole)
    back = blocks.block_pixels(spark.read.parquet(path), ["b", "a"], ["region"])
    short = lambda x: None if x is None else np.float32(x)
    assert sorted((r["region"], r["row"], r["col"], short(r["a"]), short(r["b"])) for r in back.collect()) == sorted(((g, y, x, short(a), short(b)) for g, y, x, a, b in cells), key=lambda t: t[:3])
    assert blocks.tensor_blocks(pixels.filter("false"), ["a"], ["region"]).count() == 0 and blocks.read_raster(spark, path, "region = 'nowhere'").size == 0
