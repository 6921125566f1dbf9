"""Subgroup bias: slice statistics, histogram divergence, disparity of label rates, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import clean

BINS, EPSILON, MIN_VALUES, MIN_ROWS, MAX_KL, MAX_DISPARITY = 20, 1e-10, 5, 10, 0.1, 0.05


def _values(columns: list[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))


def _slices(dimensions: dict[str, str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(label).alias("slice_dimension"), F.col(c).cast("string").alias("slice_value")) for label, c in dimensions.items()]))


def _four(x: Column) -> Column:
    """x to four decimals, ties of the scaled double away from zero (the decimal text of x, which round() takes, can tie where the double doesn't)."""
    return F.signum(x) * F.floor(F.abs(x) * 10000 + 0.5) / 10000


def slice_stats(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """feature, n, mean, std, median, p5, p95 (four decimals) and null_rate; features without values are left out."""
    keys = [*(keys or []), "feature"]
    long = df.select(*keys[:-1], _values(columns).alias("x")).select(*keys[:-1], "x.*")
    v = F.col("value")
    out = long.groupBy(*keys).agg(F.count(v).alias("n"), _four(F.avg(v)).alias("mean"), _four(F.stddev_samp(v)).alias("std"), _four(F.avg(v.isNull().cast("double"))).alias("null_rate"))
    ranks = clean.percentiles(long, keys, "value", [0.05, 0.5, 0.95])
    same = F.lit(True)
    for k in keys:  # a null key is a group of its own
        same = same & out[k].eqNullSafe(ranks[k])
    joined = out.filter("n > 0").join(ranks, same)
    return joined.select(*[out[k] for k in keys], "n", "mean", "std", _four(F.col("p1")).alias("median"), _four(F.col("p0")).alias("p5"), _four(F.col("p2")).alias("p95"), "null_rate")


def kl_divergence(df: DataFrame, columns: list[str], dimensions: dict[str, str]) -> DataFrame:
    """slice_dimension, slice_value, feature and kl: divergence of a slice's histogram from that of all rows.

    20 equal bins over the range of all rows. Fewer than 5 values on a side, or a constant, give 0. Two aggregates: the
    ranges (one row for each feature) and the counts by slice and bin; nothing else of the rows is moved.
    """
    long = df.select(*dimensions.values(), _values(columns).alias("x")).select(*dimensions.values(), "x.feature", "x.value").filter("value is not null")
    ranges = long.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n_all"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))).otherwise(0)
    binned = long.join(F.broadcast(ranges), "feature").withColumn("bin", at)  # one range for each feature
    overall = binned.groupBy("feature", "bin", "n_all", "low", "high").agg(F.count("*").alias("c_all"))
    sliced = binned.select("feature", "bin", _slices(dimensions).alias("s")).select("feature", "bin", "s.*").filter("slice_value is not null").groupBy("slice_dimension", "slice_value", "feature", "bin").agg(F.count("*").alias("c"))
    totals = sliced.groupBy("slice_dimension", "slice_value", "feature").agg(F.sum("c").alias("n"))
    full = totals.join(overall, "feature").join(sliced, ["slice_dimension", "slice_value", "feature", "bin"], "left")
    p, q = F.coalesce("c", F.lit(0)) / F.col("n"), F.col("c_all") / F.col("n_all")
    term = F.when((p > EPSILON) | (q > EPSILON), (p + EPSILON) * F.log((p + EPSILON) / (q + EPSILON))).otherwise(0.0)
    usable = (F.col("n") >= MIN_VALUES) & (F.col("n_all") >= MIN_VALUES) & (F.col("high") > F.col("low"))
    return full.groupBy("slice_dimension", "slice_value", "feature").agg(F.greatest(F.sum(F.when(usable, term).otherwise(0.0)), F.lit(0.0)).alias("kl"))


def bias_slices(df: DataFrame, label: str, dimensions: dict[str, str]) -> DataFrame:
    """Rows, share, label rate and disparity of each slice of at least 10 rows, all dimensions in one pass."""
    overall = df.agg(F.count("*").alias("n_all"), F.avg(F.col(label).cast("double")).alias("rate_all"))
    out = df.select(label, _slices(dimensions).alias("s")).select(label, "s.*").filter("slice_value is not null").groupBy("slice_dimension", "slice_value").agg(F.count("*").alias("row_count"), F.avg(F.col(label).cast("double")).alias("fire_rate"))
    out = out.filter(F.col("row_count") >= MIN_ROWS).crossJoin(F.broadcast(overall))  # one row
    gap = F.abs(F.col("fire_rate") - F.col("rate_all"))
    return out.select("slice_dimension", "slice_value", "row_count", F.round(F.col("row_count") / F.col("n_all") * 100, 4).alias("pct_of_total"), F.round("fire_rate", 6).alias("fire_rate"), F.round(gap, 6).alias("fire_rate_disparity"), (gap > MAX_DISPARITY).alias("fire_rate_biased"))


def slice_null_rates(df: DataFrame, columns: list[str], dimensions: dict[str, str]) -> DataFrame:
    """null_rate (four decimals) of each feature in each slice of at least 10 rows, all dimensions in one pass."""
    rates = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.avg(F.col(c).isNull().cast("double")), 4).alias("null_rate")) for c in columns])
    out = df.select(*columns, _slices(dimensions).alias("s")).select(*columns, "s.*").filter("slice_value is not null").groupBy("slice_dimension", "slice_value").agg(F.count("*").alias("row_count"), rates.alias("rates"))
    return out.filter(F.col("row_count") >= MIN_ROWS).select("slice_dimension", "slice_value", F.explode("rates").alias("x")).select("slice_dimension", "slice_value", "x.*")


def slice_values(df: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """slice_dimension, slice_value and its position among the values of its dimension, which are sorted as text."""
    values = df.select(_slices(dimensions).alias("s")).select("s.*").filter("slice_value is not null").distinct()
    return values.withColumn("position", F.row_number().over(Window.partitionBy("slice_dimension").orderBy("slice_value")))


def findings(slices: DataFrame, divergences: DataFrame) -> DataFrame:
    """One sentence for each biased slice and feature, or a single one if there is none."""
    shifted = divergences.filter(F.col("kl") > MAX_KL).select("slice_dimension", "slice_value", F.format_string("%s = %s: %s is distributed differently from the whole (KL %.3f, limit %.1f)", "slice_dimension", "slice_value", "feature", "kl", F.lit(MAX_KL)).alias("finding"))
    uneven = slices.filter("fire_rate_biased").select("slice_dimension", "slice_value", F.format_string("%s = %s: fires are detected at a rate of %.3f, %.3f from the overall rate (limit %.2f)", "slice_dimension", "slice_value", "fire_rate", "fire_rate_disparity", F.lit(MAX_DISPARITY)).alias("finding"))
    found = shifted.unionByName(uneven)
    none = found.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("").alias("slice_dimension"), F.lit("").alias("slice_value"), F.lit("no slice differs beyond the limits").alias("finding"))
    return found.unionByName(none)
