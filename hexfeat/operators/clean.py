"""Point detections: cleaning, clipping, raw checks. Keyed columns, so many windows run in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

CLIP_AT = 0.995
#: Ranks on either side of a percentile that are looked at, as a share, and values up to which all are.
MARGIN, SMALL = 0.001, 10_000


def clean_detections(df: DataFrame) -> DataFrame:
    """Drops rows without a position; confidence and frp become doubles or null."""
    return df.dropna(subset=["latitude", "longitude"]).withColumns({"confidence": scalar.confidence("confidence"), "frp": scalar.number("frp")})


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys and p0, p1, ...: the exact percentiles (linear between two ranks) of the non-null values of each group, in one pass.

    A sketch of bounded size brackets each percentile of a large group; only values in a bracket are then counted and
    ranked, those between two brackets are one row. So the work on a hot key is map-side but for a five-hundredth of its
    values for each percentile. shares have to rise.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    ends = F.percentile_approx("_x", [min(1.0, max(0.0, p + m)) for p in shares for m in (-MARGIN, MARGIN)], 10_000)
    spans = known.groupBy(*keys).agg(F.count("*").alias("_n"), ends.alias("_ends"))
    beside = known.join(spans, keys) if keys else known.crossJoin(F.broadcast(spans))  # one row
    lows, highs = ([F.col("_ends")[2 * i + side] for i in range(len(shares))] for side in (0, 1))
    inside = F.col("_n") <= SMALL
    for low, high in zip(lows, highs, strict=True):
        inside = inside | F.col("_x").between(low, high)
    # What lies between two brackets is one row right behind the lower one.
    behind = F.greatest(*[F.when(high < F.col("_x"), high) for high in highs], F.lit(None).cast("double"))
    counted = beside.select(*keys, "_n", F.when(inside, F.col("_x")).otherwise(behind).alias("_at"), (~inside).alias("_rest")).groupBy(*keys, "_n", "_at", "_rest").agg(F.count("*").alias("_of"))
    counted = counted.withColumn("_upto", F.sum("_of").over(Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first(), "_rest")))
    place = [(F.col("_n") - 1) * F.lit(p) for p in shares]
    ranked = lambda at: F.min(F.when(~F.col("_rest") & (F.col("_upto") > at), F.col("_at")))
    found = counted.groupBy(*keys, "_n").agg(*[ranked(f(p)).alias(f"_{name}{i}") for i, p in enumerate(place) for name, f in (("low", F.floor), ("high", F.ceil))])
    return found.select(*keys, *[(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (p - F.floor(p))).alias(f"p{i}") for i, p in enumerate(place)])


def clip_frp(df: DataFrame, keys: list[str], at: float = CLIP_AT) -> DataFrame:
    """frp above the `at` percentile of its key group is lowered to it, below 0 raised to 0; nulls stay."""
    tops = percentiles(df, keys, "frp", [at]).withColumnRenamed("p0", "_top")
    joined = df.join(tops, keys, "left") if keys else df.join(F.broadcast(tops), how="left")  # one row, or none
    return joined.withColumn("frp", F.when(F.col("frp").isNotNull(), F.greatest(F.least("frp", F.coalesce("_top", "frp")), F.lit(0.0)))).drop("_top")


def validate_raw(df: DataFrame) -> DataFrame:
    """One row: rows, rows outside the wide box, rows with negative frp, whether all is valid. An empty table is valid."""
    lat = F.col("latitude").isNull() | ~F.col("latitude").between(20, 50)
    lon = F.col("longitude").isNull() | ~F.col("longitude").between(-130, -85)
    out = df.agg(F.count("*").alias("n_rows"), F.count_if(lat).alias("bad_latitude"), F.count_if(lon).alias("bad_longitude"), F.count_if(F.col("frp") < 0).alias("negative_frp"))
    return out.withColumn("valid", (F.col("bad_latitude") == 0) & (F.col("bad_longitude") == 0) & (F.col("negative_frp") == 0))


def in_lookback(df: DataFrame, time: str, now, minutes: int, min_frp: float) -> DataFrame:
    """Detections not older than so many minutes before now, of at least min_frp (a null frp counts as 0)."""
    return df.filter((F.col(time) >= now - F.make_dt_interval(mins=F.lit(minutes))) & (F.coalesce("frp", F.lit(0.0)) >= min_frp))
