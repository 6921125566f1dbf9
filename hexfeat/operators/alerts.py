"""Mode by season, the timer that takes back false alarms, escalation of repeated failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import run_lengths

FIRE_MONTHS, REVERT_MINUTES, BREACH_FROM = (6, 11), 30, 3


def seasonal_mode(mode: Column, at: Column) -> Column:
    """The mode as it is, but active instead of quiet (or unknown) from June to November."""
    mode = F.coalesce(mode, F.lit("quiet"))
    return F.when((mode == "quiet") & F.month(at).between(*FIRE_MONTHS), "active").otherwise(mode)


def revert_timer(polls: DataFrame, keys: list[str], order: str, minutes: int = REVERT_MINUTES) -> DataFrame:
    """A timer in event time: a false alarm sets it anew, the first later poll at or beyond its end takes the mode back.

    polls: keys, the time `order` (once for each key), mode, confirmed, false_alarm; nulls count as false. Adds revert_at
    (of the timer that still runs), reverted, and puts the mode of the last false alarm where the timer has ended.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alarm = F.coalesce("false_alarm", F.lit(False)) & ~F.coalesce("confirmed", F.lit(False))
    end = F.last(F.when(alarm, F.col(order)), ignorenulls=True).over(w) + F.make_dt_interval(mins=F.lit(minutes))
    out = polls.withColumns({"_end": end, "_prior": F.last(F.when(alarm, F.col("mode")), ignorenulls=True).over(w)})
    out = out.withColumn("_over", F.coalesce(F.col(order) >= F.col("_end"), F.lit(False)))
    timer = Window.partitionBy(*keys, "_end").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("_nth", F.count_if("_over").over(timer))
    out = out.withColumn("reverted", F.col("_over") & (F.col("_nth") == 1))
    out = out.withColumns({"revert_at": F.when(F.col("_nth") == 0, F.col("_end")), "mode": F.when(F.col("reverted"), F.coalesce("_prior", F.lit("quiet"))).otherwise(F.col("mode"))})
    return out.drop("_end", "_prior", "_over", "_nth")


def escalations(runs: DataFrame, keys: list[str], order: str, failed: Column, least: int = BREACH_FROM) -> DataFrame:
    """Failed runs with the number of failures in a row up to them, and the level breach from `least` on, else failed."""
    out = run_lengths(runs, keys, order, failed, "consecutive").filter("consecutive > 0")
    return out.withColumn("level", F.when(F.col("consecutive") >= least, "breach").otherwise("failed"))
