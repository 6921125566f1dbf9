"""Backfill with a ledger of windows: what fails is isolated, told and tried again; and statistics taken while writing."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .io import write_windows

_LEDGER = "window_ts timestamp_ntz, status string, error string, attempt_ts timestamp"
#: Characters of an error that the ledger keeps.
_TOLD = 500


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """window_ts, status (processed or failed) and error of the last attempt at each window."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_windows")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(_LEDGER).parquet(f"{path}/_windows") if there else spark.createDataFrame([], _LEDGER)
    last = F.max_by(F.struct("status", "error"), F.struct("attempt_ts", F.col("status") == "processed"))
    return rows.groupBy("window_ts").agg(last.alias("x")).select("window_ts", "x.status", "x.error")


def backfill(spark: SparkSession, calendar: DataFrame, build: Callable[[DataFrame], DataFrame], path: str) -> dict[str, int]:
    """Writes build(windows) for all windows of the calendar that the ledger under path doesn't have as processed; returns counts.

    build gets a table of window_ts and gives rows with window_ts; it is lazy, so errors come when a job runs. All
    windows are one job. If it fails, each half of them is a job of its own, down to the single windows that fail: n
    windows with f failures take about 2 f log n jobs, and the others are written. A window is replaced as a whole and
    enters the ledger after that, so a run that breaks off leaves nothing twice; failed windows are tried in the next run.
    """
    done = ledger(spark, path).filter("status = 'processed'").select("window_ts")
    every = calendar.select("window_ts").distinct()
    total = every.count()
    todo = sorted(r["window_ts"] for r in every.join(done, "window_ts", "left_anti").collect())  # four windows a day
    counts = {"total": total, "processed": 0, "skipped": total - len(todo), "failed": 0}

    def note(windows: list[dt.datetime], status: str, error: str | None) -> None:
        rows = [(w, status, error, dt.datetime.now()) for w in windows]
        spark.createDataFrame(rows, _LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/_windows")
        counts[status] += len(windows)

    def attempt(windows: list[dt.datetime]) -> None:
        chosen = spark.createDataFrame([(w,) for w in windows], "window_ts timestamp_ntz")
        try:
            write_windows(build(chosen), chosen, None, f"{path}/data")
        except Exception as e:  # any error of a window is told in the ledger
            if len(windows) == 1:
                note(windows, "failed", f"{type(e).__name__}: {e}"[:_TOLD])
                return
            middle = len(windows) // 2
            attempt(windows[:middle])
            attempt(windows[middle:])
            return
        note(windows, "processed", None)

    if todo:
        attempt(todo)
    return counts


def write_with_statistics(df: DataFrame, write: Callable[[DataFrame], None], columns: list[str] | None = None, issues: list[str] = [], resolution_km: int | None = None) -> dict:
    """Writes df and returns its row count and null rates, observed by the very job that writes: no second pass.

    The rates of an empty table are 0. issues are what validation found, and passed says that there are none.
    """
    seen, columns = Observation(), columns or df.columns
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(columns)]))
    found = seen.get
    rows = found["rows"]
    rates = {c: found[f"nulls_{i}"] / rows if rows else 0.0 for i, c in enumerate(columns)}
    return {"run_at": dt.datetime.now(dt.UTC).isoformat(), "row_count": rows, "resolution_km": resolution_km, "passed": not issues, "issue_count": len(issues), "issues": list(issues), "column_null_rates": rates}


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """A summary as one JSON file that replaces the one before."""
    spark.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.mode("overwrite").text(path)
