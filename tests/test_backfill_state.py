"""Ledgers, statistics, versioned state and the records of the watchdog."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from hexfeat.operators import records, reports
from hexfeat.sources import backfill, io
from hexfeat.sources.state import Versions

T0 = dt.datetime(2024, 1, 1)


def test_failing_windows_leave_the_others_written(spark, tmp_path):
    at = lambda k: T0 + dt.timedelta(hours=6 * k)
    rows = spark.createDataFrame([(at(k), i) for k in range(9) for i in range(k + 1)], "window_ts timestamp_ntz, i int")
    calendar, path, jobs, bad = reports.calendar_of(rows, "window_ts"), str(tmp_path / "out"), [], [2, 7]
    assert calendar.count() == 9 and reports.calendar_of(rows.filter("false"), "window_ts").count() == 0

    def build(windows):
        jobs.append(1)
        broken = F.col("window_ts").isin(*[F.lit(at(k)).cast("timestamp_ntz") for k in bad]) if bad else F.lit(False)
        return rows.join(windows, "window_ts").withColumn("i", F.when(broken, F.raise_error(F.lit("no payload")).cast("int")).otherwise(F.col("i")))

    assert backfill.backfill(spark, calendar, build, path) == {"total": 9, "processed": 7, "skipped": 0, "failed": 2}
    assert len(jobs) <= 2 * 2 * 4 + 1
    told = {r["window_ts"]: r for r in backfill.ledger(spark, path).collect()}
    assert {t for t, r in told.items() if r["status"] == "failed"} == {at(2), at(7)} and "no payload" in told[at(2)]["error"]
    count = lambda: {r["window_ts"]: r["count"] for r in io.read_features(spark, f"{path}/data").groupBy("window_ts").count().collect()}
    assert count() == {at(k): k + 1 for k in range(9) if k not in (2, 7)}
    bad.remove(7)
    jobs.clear()
    assert backfill.backfill(spark, calendar, build, path) == {"total": 9, "processed": 1, "skipped": 7, "failed": 1}
    assert len(jobs) == 3 and count()[at(7)] == 8
    bad.clear()
    assert backfill.backfill(spark, calendar, build, path)["processed"] == 1 and backfill.backfill(spark, calendar, build, path) == {"total": 9, "processed": 0, "skipped": 9, "failed": 0}
    assert count() == {at(k): k + 1 for k in range(9)}


def test_statistics_of_the_writing_job(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None), (4, None)], "a int, b string")
    summary = backfill.write_with_statistics(df, lambda d: d.write.parquet(str(tmp_path / "t")), resolution_km=22)
    assert (summary["row_count"], summary["passed"], summary["column_null_rates"]) == (4, True, {"a": 0.25, "b": 0.75})
    empty = backfill.write_with_statistics(df.filter("false"), lambda d: d.write.parquet(str(tmp_path / "e")), issues=["empty"])
    assert (empty["row_count"], empty["passed"], empty["issue_count"], empty["column_null_rates"]) == (0, False, 1, {"a": 0.0, "b": 0.0})
    for told in (empty, summary):
        backfill.write_summary(spark, told, str(tmp_path / "stats"))
    assert json.loads(spark.read.text(str(tmp_path / "stats")).first()[0]) == summary


def test_one_of_several_writers_wins(spark, tmp_path):
    state = Versions(spark, str(tmp_path / "state"))
    generation, first = state.read()
    assert (generation, first["mode"]) == (0, "quiet")
    won, gate = [], threading.Barrier(8)

    def writer(k):
        gate.wait()
        if state.write({"mode": "active", "writer": k}, 0):
            won.append(k)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    generation, now = state.read()
    assert len(won) == 1 and (generation, now["writer"], now["revert_at"]) == (1, won[0], None)
    assert not state.write({"mode": "late"}, 0) and not state.write({"mode": "early"}, 5) and state.read()[1]["mode"] == "active"
    for _ in range(5):
        state.update(lambda s: s | {"consecutive_fire_scans": s["consecutive_fire_scans"] + 1})
    assert state.read()[0] == 6 and state.read()[1]["consecutive_fire_scans"] == 5
    state.prune(2)
    assert state.read()[0] == 6 and len(list((tmp_path / "state").glob("*.json"))) == 2


def test_exclusive_create_where_links_are_missing(spark, tmp_path):
    state = Versions(spark, str(tmp_path / "state"))
    state._local = None
    assert state.write({"mode": "a"}, 0) and not state._create('{"mode": "b"}', "1.json") and state.read()[1]["mode"] == "a"


TOLD = "region string, at timestamp, kind string, n_candidates long, n_spatial long, n_persistent long, max_frp double, gate_failed string, confirmed boolean, fire_cells array<string>, mode string, event string"


def test_records_of_a_batch_replace_themselves(spark, tmp_path):
    rows = [
        ("ca", T0, "scan", 3, 3, 0, 250.0, None, True, ["b", "a"], "emergency", "activated"), ("tx", T0, "scan", 2, 0, 0, 12.0, "G1", False, [], "quiet", None),
        ("tx", T0, "scan", 0, 0, 0, 0.0, "no_detections", False, [], "quiet", None), ("ca", T0, "revert", None, None, None, None, None, None, [], "quiet", "deactivated"), (None, T0, "scan", 3, 3, 3, 60.0, None, True, ["c"], "odd", None),
    ]
    batch = spark.createDataFrame(rows, TOLD)
    write = records.write_records(str(tmp_path))
    write(batch, 4)
    write(batch, 4)
    read = lambda kind: spark.read.json(str(tmp_path / kind)).collect()
    triggers = {r["mode"]: r for r in read("triggers")}
    assert (triggers["emergency"]["resolution_km"], triggers["emergency"]["trigger_source"], triggers["emergency"]["fire_cells"], triggers["emergency"]["detection_range_km"]) == (22, "watchdog_emergency", ["a", "b"], 25)
    assert triggers["odd"]["resolution_km"] == 64 and len(triggers) == 2
    assert [(r["gate_failed"], r["summary"]["candidate_cells"]) for r in read("false_alarms")] == [("G1", 2)]
    assert sorted((r["event"], r["details"]["region"]) for r in read("emergency")) == [("activated", "ca"), ("deactivated", "ca")]
    assert records.trigger_records(batch.filter("false")).count() == 0


def test_ids_follow_from_the_record(spark):
    rows = spark.createDataFrame([("ca", T0), ("ca", T0), ("tx", T0), (None, T0)], "region string, at timestamp")
    ids = [r[0] for r in rows.select(records.record_id("trigger", "region", "at")).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 3 and pytest.approx(32) == len(ids[0])
