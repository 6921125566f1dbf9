"""Gates, incidents and false-alarm timers of a region in one stateful operator.

A scan of a region goes through the four gates in order, against the cells of the scan before, which are map state; what
is confirmed moves the incident, whose mode and counters are value state; a false alarm sets a timer that takes the mode
back, with or without another scan. State is keyed by region and holds two sets of cells, both bounded by the region's
grid. Verdicts are those of operators.gates.evaluate, transitions those of operators.gates.incident_replay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.alerts import FIRE_MONTHS, REVERT_MINUTES
from ..operators.gates import BYPASS_FRP, COLD_FRP, NEIGHBOURS, PERSISTENCE

SCAN = "region string, scan_ms long, cells array<string>, max_frp double, reference array<string>, hot array<string>"
_OUT = "region string, at_ms long, kind string, n_candidates long, n_spatial long, n_persistent long, max_frp double, gate_failed string, confirmed boolean, fire_cells array<string>, mode string, expanding int, still int, low int, revert_ms long, event string"
_STATE = "mode string, prior string, expanding int, still int, low int, consecutive int, last_ms long, had_cells boolean, revert_ms long, revert_mode string"
_AROUND = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))


@dataclass(frozen=True)
class Rules:
    """gated: scans pass the gates; else each is confirmed with all its cells. seasonal: quiet turns to active in the
    season. gap_hours: how long ago the scan before must be to count as one, None for any. fire_frp: scans from this
    strength on count as consecutive fire scans; None counts confirmed ones. clock: EventTime or ProcessingTime, of the
    timer that takes back false alarms after revert_minutes (None: never)."""

    gated: bool = True
    seasonal: bool = True
    gap_hours: float | None = None
    fire_frp: float | None = None
    min_scans: int = PERSISTENCE
    revert_minutes: float | None = REVERT_MINUTES
    clock: str = "EventTime"


@dataclass
class Incident:
    mode: str = "quiet"
    prior: str = "quiet"
    expanding: int = 0
    still: int = 0
    low: int = 0
    consecutive: int = 0
    last_ms: int | None = None
    had_cells: bool = False
    revert_ms: int | None = None
    revert_mode: str | None = None

    def step(self, grown: bool, frp: float) -> None:
        """The state machine's transition after a confirmed scan; grown: it has cells that the one before hadn't."""
        if self.mode == "emergency":
            self.still, self.low = (0 if grown else self.still + 1), (self.low + 1 if frp < BYPASS_FRP else 0)
            if self.still >= 3 or self.low >= 2:
                self.mode, self.still, self.low = self.prior, 0, 0
        else:
            self.still = self.low = 0
            self.expanding = self.expanding + 1 if frp >= COLD_FRP and grown else 0
            if frp >= COLD_FRP and self.expanding >= 2:
                self.mode, self.prior = "emergency", self.mode


def _near(cell: str) -> list[str]:
    level, q, r = cell.split("_")
    return [f"{level}_{int(q) + a}_{int(r) + b}" for a, b in _AROUND]


def judge(cells: set[str], frp: float, reference: set[str], hot: set[str], before: set[str] | None, consecutive: int, min_scans: int) -> tuple[int, int, str | None, set[str]]:
    """Counts after the first two gates, the gate that failed (None: confirmed), and the fire cells. before is None without a scan before."""
    spatial = {c for c in cells if sum(n in cells for n in _near(c)) >= NEIGHBOURS}
    persistent = spatial & (before or set())
    left = persistent if before is not None and persistent else spatial
    if frp < BYPASS_FRP and reference:
        left = {c for c in left if c in reference or any(n in reference for n in _near(c))}
    fires = left - hot
    if not cells:
        failed = "no_detections"
    elif not spatial:
        failed = "G1"
    elif before is not None and not persistent and consecutive + 1 < min_scans:
        failed = "G2_pending"
    elif before is None and frp < COLD_FRP:
        failed = "G2_no_prior_scan"
    else:
        failed = "G3" if not left else "G4" if not fires else None
    return len(spatial), len(spatial & before) if before else 0, failed, set() if failed else fires


class Watch(StatefulProcessor):
    """One region's scans in order of time. Scans that aren't newer than the last one are repeated polls and are left out."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.incident = handle.getValueState("incident", _STATE)
        self.before = handle.getMapState("before", "grid_id string", "seen boolean")
        self.active = handle.getMapState("active", "grid_id string", "seen boolean")

    def close(self) -> None:
        pass

    def _load(self) -> Incident:
        return Incident(*self.incident.get()) if self.incident.exists() else Incident()

    def _save(self, now: Incident) -> None:
        self.incident.update((now.mode, now.prior, now.expanding, now.still, now.low, now.consecutive, now.last_ms, now.had_cells, now.revert_ms, now.revert_mode))

    @staticmethod
    def _swap(state, old: set[str], new: set[str]) -> None:
        for cell in old - new:
            state.removeKey((cell,))
        for cell in new - old:
            state.updateValue((cell,), (True,))

    def _revert(self, region: str, now: Incident) -> tuple:
        at, was = now.revert_ms, now.mode
        now.mode, now.revert_ms, now.revert_mode = now.revert_mode or "quiet", None, None
        return (region, at, "revert", None, None, None, None, None, None, [], now.mode, now.expanding, now.still, now.low, None, _event(was, now.mode))

    def _scan(self, region: str, row, now: Incident, before: set[str], active: set[str], clock_ms: int) -> tuple[tuple, set[str], set[str]]:
        rules, cells, was = self.rules, set(row.cells) if row.cells is not None else set(), now.mode
        frp = 0.0 if pd.isna(row.max_frp) else float(row.max_frp)
        if rules.seasonal and now.mode == "quiet" and FIRE_MONTHS[0] <= pd.Timestamp(row.scan_ms, unit="ms").month <= FIRE_MONTHS[1]:
            now.mode = "active"
        if rules.gated:
            sets = [set(x) if x is not None else set() for x in (row.reference, row.hot)]
            follows = now.had_cells and (rules.gap_hours is None or row.scan_ms - now.last_ms == rules.gap_hours * 3_600_000)
            n_spatial, n_persistent, failed, fires = judge(cells, frp, *sets, before if follows else None, now.consecutive, rules.min_scans)
        else:
            n_spatial, n_persistent, failed, fires = len(cells), len(cells & before), None, cells
        if failed is None:
            now.step(bool(fires - active), frp)
            active = fires
        elif cells and rules.revert_minutes is not None:
            if now.revert_ms is not None:
                self.handle.deleteTimer(now.revert_ms)
            now.revert_ms, now.revert_mode = clock_ms + int(rules.revert_minutes * 60_000), now.mode
            self.handle.registerTimer(now.revert_ms)
        strong = failed is None if rules.fire_frp is None else bool(cells) and frp >= rules.fire_frp
        now.consecutive = now.consecutive + 1 if strong else 0
        now.last_ms, now.had_cells = row.scan_ms, bool(cells)
        out = (region, row.scan_ms, "scan", len(cells), n_spatial, n_persistent, frp, failed, failed is None, sorted(fires), now.mode, now.expanding, now.still, now.low, now.revert_ms, _event(was, now.mode))
        return out, cells, active

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, out = self._load(), []
        held = tuple({k[0] for k in state.keys()} for state in (self.before, self.active))
        before, active = held
        in_events = self.rules.clock == "EventTime"
        for row in pd.concat(list(rows)).sort_values("scan_ms").itertuples():  # the scans of one region in one micro-batch
            if now.last_ms is not None and row.scan_ms <= now.last_ms:
                continue
            clock_ms = row.scan_ms if in_events else timerValues.getCurrentProcessingTimeInMs()
            if now.revert_ms is not None and clock_ms >= now.revert_ms:  # before the timer could
                self.handle.deleteTimer(now.revert_ms)
                out.append(self._revert(key[0], now))
            told, before, active = self._scan(key[0], row, now, before, active, clock_ms)
            out.append(told)
        self._swap(self.before, held[0], before)
        self._swap(self.active, held[1], active)
        self._save(now)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = self._load(), []
        if now.revert_ms == expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._revert(key[0], now))
            self._save(now)
        yield _frame(out)


def _event(was: str, now: str) -> str | None:
    return None if (was == "emergency") == (now == "emergency") else "activated" if now == "emergency" else "deactivated"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"n_candidates": "Int64", "n_spatial": "Int64", "n_persistent": "Int64", "revert_ms": "Int64", "confirmed": "boolean"}
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")]).astype(kinds)


def with_state_store(spark: SparkSession) -> None:
    """Timers and map state need the RocksDB store, which keeps state outside of the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def watch(scans: DataFrame, rules: Rules = Rules(), late: str | None = "0 seconds") -> DataFrame:
    """A row for each scan of a region, and one for each false alarm that is taken back (kind revert); event tells of emergencies.

    scans: region, scan_ts, cells (array of ids), max_frp, reference (cells of the confirming feed; empty: it is down) and
    hot (cells near an industrial source). Null arrays are empty ones, a null max_frp is 0; scans without a region are one
    region of their own. Under EventTime a revert comes when the watermark, which follows the scans of all regions,
    passes its end or the region's next scan does; under ProcessingTime by the clock of the cluster, without any input.
    late None keeps the watermark that scans has already.
    """
    with_state_store(scans.sparkSession)
    rows = (scans if late is None else scans.withWatermark("scan_ts", late)).select("region", F.unix_millis(F.col("scan_ts").cast("timestamp")).alias("scan_ms"), "cells", F.col("max_frp").cast("double").alias("max_frp"), "reference", "hot", "scan_ts")
    told = rows.groupBy("region").transformWithStateInPandas(Watch(rules), _OUT, "Append", rules.clock)
    at = lambda c: F.timestamp_millis(F.col(c))
    return told.select("region", at("at_ms").alias("at"), "kind", "n_candidates", "n_spatial", "n_persistent", "max_frp", "gate_failed", "confirmed", "fire_cells", "mode", "expanding", "still", "low", at("revert_ms").alias("revert_at"), "event")


def incidents(scans: DataFrame) -> DataFrame:
    """The state machine alone: a row for each scan (region, scan_ts, cells, max_frp), each counted as confirmed with all its cells."""
    none = F.array().cast("array<string>")
    told = watch(scans.select("region", "scan_ts", "cells", "max_frp", none.alias("reference"), none.alias("hot")), Rules(gated=False, seasonal=False, revert_minutes=None))
    return told.select("region", F.col("at").alias("scan_ts"), "mode", "expanding", "still", "low")
