"""Hand-computed cases of the gate evaluator, the revert timer, the season and the escalation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hexfeat.operators import alerts, gates

T0 = dt.datetime(2024, 8, 1)
CELLS = "scan string, grid_id string, frp double"
SCANS = "scan string, has_prior boolean, consecutive int"
SOURCES = "s_lat double, s_lon double, radius_km double"
TRIANGLE = ("5_0_0", "5_1_0", "5_0_1")


def evaluated(spark, scan, frp=30.0, cells=TRIANGLE, prior=(), reference=("5_9_9", "5_50_50"), sources=()):
    now = spark.createDataFrame([("s", c, frp) for c in cells], CELLS)
    before = spark.createDataFrame([("s", c, frp) for c in prior], CELLS)
    seen = spark.createDataFrame([("s", c, 5.0) for c in reference], CELLS)
    places = spark.createDataFrame(list(sources), SOURCES)
    verdicts, fires = gates.evaluate(spark.createDataFrame([("s", *scan)], SCANS), now, before, seen, places, ["scan"], 5)
    return verdicts.first(), {r.grid_id for r in fires.collect()}


@pytest.mark.parametrize(
    ("scan", "given", "code", "n"),
    [
        ((True, 0), {"cells": ()}, "no_detections", 0),
        ((True, 5), {"cells": ("5_0_0", "5_1_0", "5_30_30")}, "G1", 0),
        ((True, 0), {"prior": ("5_8_8",)}, "G2_pending", 0),
        ((True, 1), {"prior": ("5_8_8",), "reference": TRIANGLE}, None, 3),  # enough scans in a row
        ((False, 9), {"frp": 199.0}, "G2_no_prior_scan", 0),
        ((False, 0), {"frp": 200.0}, None, 3),
        ((True, 0), {"prior": TRIANGLE}, "G3", 0),
        ((True, 0), {"prior": TRIANGLE, "reference": ()}, None, 3),  # the feed is down
        ((True, 0), {"prior": TRIANGLE[:2], "frp": 50.0}, None, 2),  # strong, so no reference is asked
        ((True, 0), {"prior": TRIANGLE, "frp": 60.0, "sources": [(0.0, 0.0, 900.0)]}, "G4", 0),
        ((True, 0), {"prior": TRIANGLE, "frp": 60.0, "sources": [(0.0, 0.0, None)]}, None, 2),
        ((True, 0), {"frp": None, "prior": TRIANGLE}, "G3", 0),
    ],
)
def test_gates_in_order(spark, scan, given, code, n):
    verdict, fires = evaluated(spark, scan, **given)
    assert (verdict.gate_failed, verdict.confirmed, verdict.n_fire_cells, len(fires)) == (code, code is None, n, n)


def test_evaluator_without_sources_and_scans(spark):
    now = spark.createDataFrame([("s", c, 60.0) for c in TRIANGLE], CELLS)
    scans = spark.createDataFrame([("s", True, 0)], SCANS)
    verdicts, fires = gates.evaluate(scans, now, now, now, None, ["scan"], 5)
    assert verdicts.first().confirmed and fires.count() == 3
    verdicts, fires = gates.evaluate(scans.filter("false"), now, now, now, None, ["scan"], 5)
    assert verdicts.count() == 0 and fires.count() == 0


def test_revert_timer(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    polls = [("r", at(0), "active", False, True), ("r", at(20), "emergency", None, True), ("r", at(40), "emergency", True, False), ("r", at(50), "emergency", False, None), ("r", at(99), "active", False, False), ("q", at(0), "quiet", False, False)]
    rows = spark.createDataFrame(polls, "region string, t timestamp_ntz, mode string, confirmed boolean, false_alarm boolean")
    out = [tuple(r) for r in alerts.revert_timer(rows, ["region"], "t").filter("region = 'r'").orderBy("t").select("mode", "revert_at", "reverted").collect()]
    assert out == [("active", at(30), False), ("emergency", at(50), False), ("emergency", at(50), False), ("emergency", None, True), ("active", None, False)]
    assert alerts.revert_timer(rows, ["region"], "t").filter("region = 'q' and revert_at is null and not reverted").count() == 1
    assert alerts.revert_timer(rows.filter("false"), ["region"], "t").count() == 0


def test_seasonal_mode(spark):
    rows = spark.createDataFrame([("quiet", 5), ("quiet", 6), (None, 11), ("emergency", 7), (None, 12)], "mode string, m int")
    got = rows.select(alerts.seasonal_mode(F.col("mode"), F.make_date(F.lit(2024), "m", F.lit(1))).alias("x")).collect()
    assert [r.x for r in got] == ["quiet", "active", "active", "emergency", "quiet"]


def test_escalation(spark):
    runs = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, True, True, False, True, None])] + [("b", 0, False)], "task string, run int, failed boolean")
    out = alerts.escalations(runs, ["task"], "run", F.col("failed")).orderBy("run").collect()
    assert [(r.run, r.consecutive, r.level) for r in out] == [(0, 1, "failed"), (1, 2, "failed"), (2, 3, "breach"), (3, 4, "breach"), (5, 1, "failed")]
