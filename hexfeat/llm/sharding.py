"""Sharding along a Hilbert curve.

Three metadata dimensions (language, source, text length) are quantised at quantiles of their whole values, so that each axis of the grid is
used evenly; a document's cell becomes an index on the Hilbert curve, documents are sorted by that index, and the
sorted run is cut into shards of nearly equal bytes. Neighbours on the curve are neighbours in every dimension, so the
files of a shard cover a small box of the metadata space and a filter on any of the dimensions can skip shards.

Rows travel without their texts. The sort is a range partitioning on (index, group, doc_id), which is unique: no key,
source or group of copies can fill a task. Sums run along the sorted partitions: one pass totals each partition, the
prefix sums of those totals (one row for each partition) are broadcast and added to a running sum within the partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
BITS = 5
#: A group of equal texts is left whole at a cut if that moves the cut by at most this share of a shard.
TOLERANCE = 0.005


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with integer coordinates below 2**bits.

    Coordinates are undone into the transposed index bit by bit, then Gray-decoded (Skilling 2004), for whole arrays.
    """
    x = [np.asarray(a, np.int64).copy() for a in axes]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    parity = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        parity ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for a in x:
            out = (out << 1) | (((a ^ parity) >> level) & 1)
    return out


def _cuts(rows: DataFrame, name: str, steps: int) -> list[tuple[str, int]]:
    """The values of a string column that hold a quantile (1, 2, ... of steps), in order, with the step that they begin in.

    Whole strings are compared. Values are counted first, so that a frequent one is a single row, and sorted by range.
    """
    values = rows.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")).repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id())
    values = common.stored(values)
    totals = values.groupBy("part").agg(F.sum("n").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("before"))  # one row for each partition
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    run = values.join(F.broadcast(bases), "part").select("value", "n", upto.alias("upto"))
    total = rows.count()
    step = F.ceil(F.col("upto") * steps / F.lit(max(total, 1)))
    begun = (F.col("upto") - F.col("n")) * steps / F.lit(max(total, 1))
    crossed = run.filter(F.ceil(begun) < step).select("value", F.floor(begun).cast("int").alias("level")).collect()  # at most `steps` values
    return sorted(map(tuple, crossed), key=lambda x: x[0].encode())


def _level(value: Column, cuts: list[tuple], kind: str) -> Column:
    """The level of the last cut that lies at or below value, 0 if none does."""
    below = F.size(F.filter(F.array(*[F.lit(c) for c, _ in cuts]).cast(f"array<{kind}>"), lambda c: c <= value))
    return F.element_at(F.array(F.lit(0), *[F.lit(level) for _, level in cuts]), below + 1)


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs (doc_id, text, lang, source).

    The law is `bytes`: sizes of shards differ by about the largest document. Equal texts share one index (the lowest
    of their own), lie side by side and stay in one shard unless their group is larger than the tolerance at a cut.
    A null text has size 1 and the checksum of the empty text; null lang or source sort as the empty string; rows that
    repeat a doc_id keep a slot each; an empty table gives an empty result; grown_shard is null under this law. Other
    columns are not read. Very long texts only enter as their length and checksum.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("digest"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("d0"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("d1"), F.octet_length(raw).cast("long").alias("d2"),
    )
    rows = common.stored(rows)
    most = 1 << bits
    lengths = rows.agg(F.percentile_approx("d2", [i / most for i in range(1, most)], 10_000)).first()[0]
    by_length = sorted({c: i for i, c in enumerate(lengths or [], 1)}.items())
    cuts = [(_cuts(rows, "d0", most), "string"), (_cuts(rows, "d1", most), "string"), (by_length, "bigint")]

    @F.pandas_udf("long")
    def index(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], bits))

    placed = rows.withColumn("h", index(*[_level(F.col(f"d{i}"), *cuts[i]) for i in range(3)]))
    copies = ["digest", "text_crc32", "size"]
    lowest = common.stored(placed.groupBy(*copies).agg(F.min("h").alias("at")))  # written, so that the join below can split a large group
    placed = placed.join(lowest, copies).select("doc_id", "size", "text_crc32", "digest", "at")

    order = ["at", "digest", "text_crc32", "size", "doc_id"]
    run = common.stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    totals = run.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"))
    total = totals.agg(F.sum("bytes")).first()[0] or 0

    within = Window.partitionBy("part").orderBy(*order)
    start = F.col("bytes0") + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = common.stored(run.join(F.broadcast(bases), "part").select(*order, start.alias("start"), (F.col("rows0") + F.row_number().over(within) - 1).alias("rank")))
    edges = [total * k / shards for k in range(1, shards)]
    edges = _whole_groups(ranked, edges, tolerance * total / shards) if total else edges
    shard = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e <= F.col("start")))
    cut = ranked.withColumn("shard", shard)
    firsts = cut.groupBy("shard").agg(F.min("rank").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _whole_groups(ranked: DataFrame, edges: list[float], most: float) -> list[float]:
    """Edges moved to the nearer end of the group of copies that they cut, where that is at most `most` bytes away."""
    on = F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: (e > F.col("start")) & (e < F.col("start") + F.col("size")))
    key = ["at", "digest", "text_crc32", "size"]
    cut = ranked.select(*key, F.explode(on).alias("edge"))  # at most one row for each edge
    ends = ranked.join(F.broadcast(cut), key).groupBy("edge").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("size")).alias("high"))
    moved = {r["edge"]: min(r["low"], r["high"], key=lambda x: abs(x - r["edge"])) for r in ends.collect()}
    return [moved[e] if e in moved and abs(moved[e] - e) <= most else e for e in edges]
