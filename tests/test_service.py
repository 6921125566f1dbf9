"""The watchdog from files to records."""

import datetime as dt
import time

from pyspark.sql import functions as F

from hexfeat.functions import grid
from hexfeat.operators import gates
from hexfeat.streaming import service, watch, watchdog

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "seq long, region string, latitude double, longitude double, frp double, acq_ts timestamp, sensor string"


def _centre(q, r, level=5):
    s = grid.SIZE[level]
    return r * 1.5 * s, (q + r / 2) * grid.ROOT3 * s / grid.SHRINK


def test_hot_cells_are_those_near_a_source(spark):
    places = [(34.0, -118.0, 60.0), (36.5, -100.0, None), (48.0, -90.0, 120.0), (None, 1.0, 5.0)]
    sources = spark.createDataFrame(places, "s_lat double, s_lon double, radius_km double")
    cells = [(q, r, *_centre(q, r)) for r in range(80, 140) for q in range(-300, -180)]
    grid_ = spark.createDataFrame(cells, "q long, r long, latitude double, longitude double").withColumn("grid_id", grid.cell_id(F.col("q"), F.col("r"), 5))
    cold = gates.gate4_industrial(grid_, sources)
    want = {r["grid_id"] for r in grid_.join(cold.select("grid_id"), "grid_id", "left_anti").collect()}
    assert {r["grid_id"] for r in service.hot_cells(sources, 5).collect()} == want and want


def test_from_files_to_records(spark, tmp_path):
    """Two scans with new persistent cells make an emergency; a lone detection is a false alarm; a cell near industry doesn't count; detections of the confirming feed are no scan of their own."""
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    base = [(-240, 90), (-239, 90), (-240, 91)]
    more = [*base, (-239, 91), (-238, 90)]
    scans = {5: (base, 300.0), 35: (more, 320.0), 65: ([*more, (-240, 92), (-241, 92)], 400.0), 95: ([*more, (-240, 92), (-241, 92)], 400.0), 125: ([(-200, 100)], 30.0), 175: ([(-200, 100)], 30.0)}
    seq, (out, place) = 0, (tmp_path / "out", tmp_path / "in")
    for minute, (cells, frp) in scans.items():
        rows = []
        for q, r in cells:
            lat, lon = _centre(q, r)
            rows.append((seq, "california", lat, lon, frp, at(minute), "goes"))
            seq += 1
        rows.append((seq, "california", *_centre(*cells[0]), 5.0 if minute == 5 else 0.0, at(minute), "viirs"))
        seq += 1
        spark.createDataFrame(rows + rows[:1], SCHEMA).coalesce(1).write.mode("append").parquet(str(place))
    lat, lon = _centre(-241, 92)
    sources = spark.createDataFrame([(lat, lon, 2.0)], "s_lat double, s_lon double, radius_km double")
    stream = watchdog.detection_stream(spark, str(place), SCHEMA, late="10 minutes", min_frp=0.0)
    rules = watch.Rules(seasonal=False, clock="ProcessingTime", revert_minutes=None)
    query = service.serve(stream, sources, str(out), str(tmp_path / "state"), confirms="sensor = 'viirs'", rules=rules, processingTime="1 second")
    read = lambda kind: [r for k in (out / kind).glob("batch=*/*.json") if k.stat().st_size for r in spark.read.json(str(k)).collect()] if (out / kind).exists() else []
    try:
        until = time.time() + 120
        while time.time() < until and query.isActive and not (len(read("triggers")) == 4 and read("false_alarms") and read("emergency")):
            time.sleep(2)
    finally:
        query.stop()
    triggers = sorted(read("triggers"), key=lambda r: r["triggered_at"])
    assert [r["mode"] for r in triggers] == ["quiet", "quiet", "quiet", "emergency"] and [len(r["fire_cells"]) for r in triggers] == [3, 3, 5, 6]
    assert [(r["event"], r["details"]["mode"]) for r in read("emergency")] == [("activated", "emergency")]
    assert {r["gate_failed"] for r in read("false_alarms")} == {"G1"}


