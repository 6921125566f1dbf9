"""The stateful watchdog: gates, timers, triggers and baselines, with restarts."""

import datetime as dt
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexfeat.operators import gates
from hexfeat.streaming import baselines, triggers, watch

T0 = dt.datetime(2024, 1, 1)
SCANS = "region string, scan_ts timestamp, cells array<string>, max_frp double, reference array<string>, hot array<string>"
TRIANGLE = ["5_0_0", "5_1_0", "5_0_1"]


def at(hours):
    return T0 + dt.timedelta(hours=hours)


class Stream:
    """A folder of scans, and a query over it that can be stopped and started again."""

    def __init__(self, spark, place, operator, schema=SCANS):
        self.spark, self.place, self.operator, self.schema = spark, place, operator, schema
        (place / "in").mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.place / "in"))
        return self

    def start(self, **trigger):
        told = self.operator(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.place / "in")))
        return told.writeStream.format("parquet").option("path", str(self.place / "out")).option("checkpointLocation", str(self.place / "state")).trigger(**trigger).start()

    def run(self):
        self.start(availableNow=True).awaitTermination()
        return self.rows()

    def rows(self):
        return self.spark.read.parquet(str(self.place / "out")).orderBy("at", "region").collect() if (self.place / "out" / "_spark_metadata" / "0").exists() else []


def test_gates_equal_the_batch_evaluator(spark, tmp_path):
    """Random scans of three regions, over several micro-batches and a restart; gaps in time count as no scan before."""
    rng = random.Random(8)
    grid = [f"5_{q}_{r}" for q in range(4) for r in range(4)]
    scans = []
    for region in "abc":
        hours = [6 * k for k in range(14) if rng.random() < 0.85]
        for h in hours:
            cells = rng.sample(grid, rng.choice([0, 1, 4, 8, 12]))
            scans.append((region, at(h), cells, rng.choice([20.0, 45.0, 60.0, 250.0, None]) if cells else None, rng.sample(grid, rng.choice([0, 2])), rng.sample(grid, rng.choice([0, 0, 9]))))
    scans.sort(key=lambda s: s[1])
    rules = watch.Rules(seasonal=False, gap_hours=6, fire_frp=40.0)
    stream = Stream(spark, tmp_path, lambda rows: watch.watch(rows, rules)).add(scans[:12]).add(scans[12:20])
    stream.run()
    got = {(r["region"], r["at"]): tuple(r[c] for c in ("n_candidates", "n_spatial", "n_persistent", "max_frp", "gate_failed", "confirmed")) + (sorted(r["fire_cells"]),) for r in stream.add(scans[20:]).run() if r["kind"] == "scan"}

    by_key = {(r, t): s for r, t, *s in scans}
    verdicts, run = [], {}
    for r, t, cells, frp, *_ in scans:
        before = by_key.get((r, t - dt.timedelta(hours=6)))
        verdicts.append((r, t, bool(before and before[0]), run.get(r, 0)))
        run[r] = run.get(r, 0) + 1 if cells and (frp or 0) >= 40 else 0
    keys = "region string, scan_ts timestamp"
    flat = lambda k: [(r, t, c, s[1]) for (r, t), s in by_key.items() for c in s[k]]
    prior = [(r, t + dt.timedelta(hours=6), c, 1.0) for (r, t), s in by_key.items() for c in s[0]]
    frame = lambda rows: spark.createDataFrame(rows, f"{keys}, grid_id string, frp double")
    told, fires = gates.evaluate(spark.createDataFrame(verdicts, f"{keys}, has_prior boolean, consecutive int"), frame(flat(0)), frame(prior), frame([(r, t, c, 5.0) for r, t, c, _ in flat(2)]), None, ["region", "scan_ts"], 5)
    want = {(r["region"], r["scan_ts"]): r for r in told.collect()}
    burning = {}
    for r in fires.collect():
        burning.setdefault((r["region"], r["scan_ts"]), set()).add(r["grid_id"])
    assert got.keys() == want.keys()
    for key, row in want.items():
        left = sorted(burning.get(key, set()) - set(by_key[key][3]))
        code = row["gate_failed"] or ("G4" if not left else None)  # the batch form got no sources
        assert got[key] == (row["n_candidates"], row["n_spatial"], row["n_persistent"], row["max_frp"], code, code is None, left if code is None else [])


def test_false_alarm_is_taken_back_without_another_scan(spark, tmp_path):
    """The timer survives a restart, and another region's scan moves the watermark beyond its end."""
    stream = Stream(spark, tmp_path, lambda rows: watch.watch(rows, watch.Rules(seasonal=False)))
    alarm = ("ca", at(0), ["5_0_0"], 30.0, [], [])  # isolated: G1 fails
    first = stream.add([alarm]).run()
    assert [(r["gate_failed"], r["revert_at"]) for r in first] == [("G1", at(0.5))]
    later = stream.add([("tx", at(2), [], None, [], [])]).run()
    assert [(r["region"], r["kind"], r["at"], r["mode"]) for r in later] == [("ca", "scan", at(0), "quiet"), ("ca", "revert", at(0.5), "quiet"), ("tx", "scan", at(2), "quiet")]
    assert len([r for r in stream.add([("ca", at(9), [], None, [], [])]).run() if r["kind"] == "revert"]) == 1


def test_revert_takes_an_emergency_back(spark, tmp_path):
    """A false alarm keeps the mode of its time; what was confirmed since then is taken back with it. A later alarm sets the timer anew."""
    strong = lambda h, cells: ("ca", at(h), cells, 300.0, [], [])
    rules = watch.Rules(seasonal=False, revert_minutes=600)
    stream = Stream(spark, tmp_path, lambda rows: watch.watch(rows, rules))
    stream.add([("ca", at(0), ["5_0_0"], 30.0, [], []), ("ca", at(1), ["5_0_0"], 30.0, [], []), strong(2, TRIANGLE), strong(3, [*TRIANGLE, "5_1_1"]), strong(4, [*TRIANGLE, "5_1_1"])])
    scans = stream.run()
    assert [(r["mode"], r["revert_at"]) for r in scans] == [("quiet", at(10)), ("quiet", at(11)), ("quiet", at(11)), ("emergency", at(11)), ("emergency", at(11))]
    after = stream.add([("ca", at(12), [], None, [], [])]).run()[5:]
    assert [(r["kind"], r["at"], r["mode"], r["revert_at"]) for r in after] == [("revert", at(11), "quiet", None), ("scan", at(12), "quiet", None)]


def test_revert_by_the_clock(spark, tmp_path):
    rules = watch.Rules(seasonal=False, revert_minutes=0.05, clock="ProcessingTime")
    stream = Stream(spark, tmp_path, lambda rows: watch.watch(rows, rules)).add([("ca", at(0), ["5_0_0"], 30.0, [], [])])
    query = stream.start(processingTime="1 second")
    try:
        until = time.time() + 90
        while time.time() < until and not any(r["kind"] == "revert" for r in stream.rows()):
            time.sleep(1)
    finally:
        query.stop()
    assert [r["kind"] for r in stream.rows()].count("revert") == 1


def test_season_and_repeated_scans(spark, tmp_path):
    summer = dt.datetime(2024, 7, 1)
    rows = [("ca", summer, TRIANGLE, 300.0, None, None), ("ca", summer, TRIANGLE, 300.0, None, None), (None, summer, None, None, None, None)]
    found = Stream(spark, tmp_path, watch.watch).add(rows).run()
    assert [(r["region"], r["mode"], r["gate_failed"]) for r in found] == [(None, "active", "no_detections"), ("ca", "active", None)]


def _trigger(folder, name, mode):
    (folder / f"{name}.json").write_text(json.dumps({"name": name, "mode": mode, "region": "ca", "fire_cells": ["5_0_0"]}))


def test_one_trigger_a_cycle_and_none_twice(spark, tmp_path):
    """By priority and name; malformed files are left out; a cycle that fails is run again and takes the same trigger."""
    folder, acted, fails = tmp_path / "in", [], [True]
    folder.mkdir()
    for name, mode in (("c", "quiet"), ("b", "active"), ("a", "active"), ("z", "emergency")):
        _trigger(folder, name, mode)
    (folder / "bad.json").write_text("{not json")

    def act(row):
        if row["name"] == "a" and fails:
            fails.clear()
            raise RuntimeError("lost")
        acted.append(row["name"])

    def run(until, seconds=90):
        clock = triggers.trigger_cycles(spark, str(folder))
        query = clock.writeStream.foreachBatch(triggers.consume(str(tmp_path / "queue"), act)).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
        end = time.time() + seconds
        try:
            while time.time() < end and query.isActive and len(acted) < until:
                time.sleep(0.3)
        finally:
            query.stop()

    run(4)
    assert acted == ["z"] and not fails  # the query failed in the cycle of a
    run(2)
    _trigger(folder, "y", "emergency")
    _trigger(folder, "z", "emergency")  # delivered again
    run(5)
    run(6, seconds=5)  # nothing is left to take
    assert sorted(acted) == ["a", "b", "c", "y", "z"] and acted[:2] == ["z", "a"] and acted.index("y") < acted.index("c")
    book = triggers.ledger(spark, str(tmp_path / "queue")).filter("name is not null").orderBy("cycle").collect()
    assert [r["name"] for r in book] == acted and len({r["cycle"] for r in book}) == 5


@pytest.mark.parametrize("learn", [True, False])
def test_baselines_window_by_window(spark, tmp_path, learn):
    """Against arrays kept whole: few values, seeding, a constant feature, outliers, both seasons, nulls, and a restart."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(12):
        season = "fire_season" if k % 3 == 0 else "off_season"
        for i in range(150 if k != 4 else 7):
            x = float(rng.normal(10 + k, 2)) + (40 if k > 8 and i < 3 else 0)
            rows.append((season, at(6 * k), x, 5.0, None if i % 2 else x))
    schema = "season string, window_ts timestamp, x double, constant double, half double"
    stream = Stream(spark, tmp_path, lambda r: baselines.running_baselines(r, ["x", "constant", "half"], learn).withColumn("at", F.col("window_ts")).withColumn("region", F.col("feature")), schema)
    stream.add([r for r in rows if r[1] < at(24)]).add([r for r in rows if at(24) <= r[1] < at(36)]).run()
    got = {(r["feature"], r["window_ts"]): r for r in stream.add([r for r in rows if r[1] >= at(36)]).run()}
    held = {}
    for k in range(12):
        for f, j in (("x", 2), ("constant", 3), ("half", 4)):
            values = np.array([r[j] for r in rows if r[1] == at(6 * k) and r[j] is not None])
            season = "fire_season" if k % 3 == 0 else "off_season"
            known = held.get((f, season), np.array([]))
            std = known.std(ddof=1) if len(known) > 1 else 0.0
            row = got[f, at(6 * k)]
            assert row["n"] == len(values) and row["samples"] == len(known)
            if len(values) < 10:
                assert row["status"] == "few_values"
            elif len(known) < 500:
                assert row["status"] == "seeding"
                held[f, season] = np.concatenate([known, values])
            elif std == 0:
                assert row["status"] == "constant"
            else:
                limit = 4.0 if season == "fire_season" else 3.5
                assert row["status"] == "scored" and row["n_anomalies"] == (np.abs((values - known.mean()) / std) > limit).sum()
                assert row["mean"] == pytest.approx(known.mean()) and row["std"] == pytest.approx(std)
                held[f, season] = np.concatenate([known, values]) if learn else known
    assert any(r["n_anomalies"] for r in got.values()) and any(r["status"] == "constant" for r in got.values())
