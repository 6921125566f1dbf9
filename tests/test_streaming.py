"""The stream ends where the batch replay ends."""

import datetime as dt

from pyspark.sql import functions as F

from hexfeat.operators import gates
from hexfeat.sources import io
from hexfeat.streaming import watch, watchdog


def run(df, spark, tmp_path, name, mode="append"):
    (df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination())
    return spark.table(name)


def test_incidents_match_replay(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    plan = [(["a"], 250.0), (["a", "b"], 260.0), (["a", "b"], 250.0), (["b"], 250.0), (["b"], 250.0), (["b", "c"], 300.0), (["d"], 300.0), (["e"], 10.0), (["f"], 5.0), ([], None)]
    rows = [(r, t0 + dt.timedelta(hours=6 * i), c, f) for r in ("ca", "tx") for i, (c, f) in enumerate(plan) if r == "ca" or i % 2 == 0]
    scans = spark.createDataFrame(rows, "region string, scan_ts timestamp, cells array<string>, max_frp double")
    for i in range(len(plan)):
        scans.filter(F.col("scan_ts") == F.lit(t0 + dt.timedelta(hours=6 * i))).coalesce(1).write.mode("append").parquet(str(tmp_path / "scans"))
    stream = spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "scans"))
    got = run(watch.incidents(stream), spark, tmp_path, "incidents")
    batch = gates.incident_replay(scans.withColumn("scan_ts", F.col("scan_ts").cast("timestamp_ntz")), ["region"]).withColumn("scan_ts", F.col("scan_ts").cast("timestamp"))
    columns = ["region", "scan_ts", "mode", "expanding", "still", "low"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    assert "emergency" in {r.mode for r in got.collect()}


def test_detections_become_scans_once(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 40, "ca", 34.0 + (i % 40) * 0.1, -118.0, 50.0 if i % 40 else 1.0, t0 + dt.timedelta(minutes=30 * (i % 40))) for i in range(80)]
    df = spark.createDataFrame(rows, "seq long, region string, latitude double, longitude double, frp double, acq_ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run(watchdog.scans(watchdog.detection_stream(spark, str(tmp_path / "in"), "seq long, region string, latitude double, longitude double, frp double, acq_ts timestamp")), spark, tmp_path, "scans")
    assert out.count() >= 2 and {r.max_frp for r in out.collect()} == {50.0}


def test_partitioned_export_and_backfill(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 31, 18)
    df = spark.createDataFrame([("a", "ca", t0), ("b", "tx", t0 + dt.timedelta(hours=6)), ("c", None, t0)], "grid_id string, region string, window_ts timestamp_ntz")
    path = str(tmp_path / "out")
    io.export_features(df, path)
    io.export_features(df.filter("region = 'tx'"), path)
    back = io.read_features(spark, path)
    assert back.count() == 3 and {r.month for r in back.collect()} == {1, 2}
    calendar = df.select("window_ts").distinct()
    assert io.write_windows(df, calendar, None, str(tmp_path / "w")).count() == 2
    assert io.write_windows(df, calendar, io.read_features(spark, str(tmp_path / "w")), str(tmp_path / "w")).count() == 0


def test_csv_sources(spark, tmp_path):
    header = "latitude,longitude,brightness,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_t31,frp,daynight\n"
    (tmp_path / "a.csv").write_text(header + "34.1,-118.2,300,1,1,2024-01-02,5,N,VIIRS,h,2,290,12.5,D\n34.1,-118.2,300,1,1,2024-01-02,x,N,VIIRS,n,2,290,oops,N\n")
    (tmp_path / "b.csv").write_text(header)
    rows = io.read_detections(spark, {("ca", "viirs"): str(tmp_path / "a.csv"), ("ca", "modis"): str(tmp_path / "b.csv")})
    got = rows.collect()
    assert len(got) == 2 and {r.frp for r in got} == {12.5, None} and {r.acq_ts for r in got} == {dt.datetime(2024, 1, 2, 0, 5), None}
    assert io.read_detections(spark, {}).count() == 0
    waits = list(io.backoff_seconds(1, 8, 6))
    assert all(0.5 * min(2**k, 8) <= w <= 1.5 * min(2**k, 8) for k, w in enumerate(waits))
