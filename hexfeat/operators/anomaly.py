"""Seasonal baselines as mergeable moments, and z-score anomalies against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IN_SEASON, OFF_SEASON, MIN_VALUES, MIN_SAMPLES = 4.0, 3.5, 10, 500


def moments(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """keys, feature, n, mean and m2 (sum of squared deviations) of the non-null values."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(*keys, "x.feature", "x.value").filter("value is not null")
    return long.groupBy(*keys, "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2"))


def merge_moments(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of both samples together, and the deviation sqrt(m2 / max(n - 1, 1)). A key may be in one of them only."""
    both = old.select(*keys, F.col("n").alias("a"), F.col("mean").alias("x"), F.col("m2").alias("p")).join(new.select(*keys, F.col("n").alias("b"), F.col("mean").alias("y"), F.col("m2").alias("q")), keys, "full_outer")
    both = both.fillna(0, ["a", "b"]).fillna(0.0, ["x", "y", "p", "q"])
    n = F.col("a") + F.col("b")
    delta = F.col("y") - F.col("x")
    m2 = F.col("p") + F.col("q") + delta * delta * F.col("a") * F.col("b") / n
    return both.select(*keys, n.alias("n"), (F.col("x") + delta * F.col("b") / n).alias("mean"), m2.alias("m2"), F.sqrt(m2 / F.greatest(n - 1, F.lit(1))).alias("std"))


def zscore_anomalies(df: DataFrame, baseline: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """feature, season, n_anomalies and max_abs_z of features with values beyond the season's threshold.

    df has a season column; a feature needs 10 values, and a baseline of 500 samples with a positive deviation.
    """
    keys = keys or []
    long = df.select("season", *keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("season", *keys, "x.*").filter("value is not null")
    known = baseline.filter((F.col("n") >= MIN_SAMPLES) & (F.col("std") > 0)).select("feature", "season", "mean", "std")
    scored = long.join(F.broadcast(known), ["feature", "season"]).withColumn("z", F.abs((F.col("value") - F.col("mean")) / F.col("std")))  # one baseline row for each feature and season
    limit = F.when(F.col("season") == "fire_season", IN_SEASON).otherwise(OFF_SEASON)
    out = scored.groupBy("feature", "season", *keys).agg(F.count("*").alias("n"), F.count_if(F.col("z") > limit).alias("n_anomalies"), F.max("z").alias("max_abs_z"))
    return out.filter((F.col("n") >= MIN_VALUES) & (F.col("n_anomalies") > 0)).drop("n")
