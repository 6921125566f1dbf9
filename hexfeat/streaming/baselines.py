"""Seasonal baselines as running state: each window is scored against what came before it, and then joins it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.anomaly import IN_SEASON, MIN_SAMPLES, MIN_VALUES, OFF_SEASON
from .watch import with_state_store

_OUT = "feature string, season string, window_ms long, n long, status string, n_anomalies long, max_abs_z double, samples long, mean double, std double"


class Baseline(StatefulProcessor):
    """n, mean and sum of squared deviations of a feature in a season; two samples merge without their values."""

    def __init__(self, learn: bool):
        self.learn = learn

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", "n long, mean double, m2 double, last_ms long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2, last = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0, None)
        limit = IN_SEASON if key[1] == "fire_season" else OFF_SEASON
        out = []
        for at, group in pd.concat(list(rows)).groupby("window_ms", sort=True):
            values = group["value"].to_numpy(np.float64)
            if last is not None and at <= last:
                continue
            last, k, found, top = int(at), len(values), 0, None
            deviation = float(np.sqrt(m2 / max(n - 1, 1)))
            known = (n, mean, deviation) if n else (0, None, None)
            if k < MIN_VALUES:
                status = "few_values"
            elif n < MIN_SAMPLES:
                status = "seeding"
            elif deviation <= 0:
                status = "constant"
            else:
                status, z = "scored", np.abs((values - mean) / deviation)
                found, top = int((z > limit).sum()), float(z.max())
            if status == "seeding" or status == "scored" and self.learn:
                delta, joined = values.mean() - mean, n + k
                m2 += float(((values - values.mean()) ** 2).sum() + delta * delta * n * k / joined)
                mean += float(delta * k / joined)
                n = joined
            out.append((*key, last, k, status, found, top, *known))
        self.moments.update((n, mean, m2, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])


def running_baselines(rows: DataFrame, columns: list[str], learn: bool = True) -> DataFrame:
    """For each feature, season and window: status, anomalies, and the baseline (samples, mean, std) that it was held against.

    rows: season, window_ts and the columns; nulls are left out. Windows of a feature are taken in order of time, those
    not newer than the last one are left out, and the rows of a window have to come in one micro-batch. Fewer than 10
    values are skipped; below 500 samples a window only seeds the baseline (without learn as well); a baseline without
    deviation neither scores nor learns. State is three numbers for each feature and season.
    """
    with_state_store(rows.sparkSession)
    long = rows.select("season", F.unix_millis(F.col("window_ts").cast("timestamp")).alias("window_ms"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x"))
    long = long.select("x.feature", "season", "window_ms", "x.value").filter("value is not null and not isnan(value) and season is not null and window_ms is not null")
    told = long.groupBy("feature", "season").transformWithStateInPandas(Baseline(learn), _OUT, "Append", "None")
    return told.select("feature", "season", F.timestamp_millis("window_ms").alias("window_ts"), "n", "status", "n_anomalies", "max_abs_z", "samples", "mean", "std")
