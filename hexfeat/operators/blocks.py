"""Rasters as dense blocks: tiles that executors build, write and read back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 64


def tensor_blocks(pixels: DataFrame, channels: list[str], scope: list[str], tile: int = TILE) -> DataFrame:
    """scope, tile_row, tile_col, size, channels and block of every tile that has a pixel.

    pixels: scope, row, col (once each, not negative) and the channels. A block is size x size x channels of little-endian
    32-bit floats in row-major order, NaN where there is no pixel or no value. Only tiles travel and no raster is ever
    whole in one place; a tile is bounded by its size.
    """
    kinds = dict(pixels.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in scope], "tile_row long, tile_col long, size int, channels array<string>, block binary"])
    placed = pixels.withColumns({"tile_row": F.floor(F.col("row") / tile), "tile_col": F.floor(F.col("col") / tile)})

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = np.full((tile, tile, len(channels)), np.nan, "<f4")
        block[rows["row"].to_numpy() % tile, rows["col"].to_numpy() % tile] = rows[channels].to_numpy(np.float32)
        return pd.DataFrame([[*key, tile, channels, block.tobytes()]], columns=[*scope, "tile_row", "tile_col", "size", "channels", "block"])

    return placed.select(*scope, "tile_row", "tile_col", "row", "col", *[F.col(c).cast("float").alias(c) for c in channels]).groupBy(*scope, "tile_row", "tile_col").applyInPandas(build, schema)


def write_blocks(blocks: DataFrame, path: str, partition: list[str]) -> None:
    """Writes blocks by partition; only partitions that blocks has are replaced, and readers see them when the job has committed."""
    blocks.hint("rebalance", *partition).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*partition).parquet(path)


def block_pixels(blocks: DataFrame, channels: list[str], scope: list[str]) -> DataFrame:
    """The pixels of blocks that have a value in any channel: scope, row, col and the channels (null for NaN)."""
    kinds = dict(blocks.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in scope], "row long, col long", *[f"{c} float" for c in channels]])

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for b in frame.itertuples():
                block = np.frombuffer(b.block, "<f4").reshape(b.size, b.size, -1)
                at = np.argwhere(~np.isnan(block).all(axis=2))
                out = pd.DataFrame(at + [b.tile_row * b.size, b.tile_col * b.size], columns=["row", "col"])
                for c in scope:
                    out[c] = getattr(b, c)
                names = list(b.channels)
                for c in channels:
                    values = block[at[:, 0], at[:, 1], names.index(c)]
                    out[c] = pd.Series(values, dtype=object).where(~np.isnan(values), None)
                yield out[[*scope, "row", "col", *channels]]

    return blocks.select(*scope, "tile_row", "tile_col", "size", "channels", "block").mapInPandas(unpack, schema)


def read_raster(spark: SparkSession, path: str, where: str) -> np.ndarray:
    """The raster of one scope (chosen by where) as height x width x channels, up to its last pixel; for the edge, where a model takes one."""
    rows = spark.read.parquet(path).filter(where).select("tile_row", "tile_col", "size", "channels", "block").collect()
    if not rows:
        return np.zeros((0, 0, 0), np.float32)
    size, channels = rows[0]["size"], len(rows[0]["channels"])
    out = np.full(((max(r["tile_row"] for r in rows) + 1) * size, (max(r["tile_col"] for r in rows) + 1) * size, channels), np.nan, np.float32)
    for r in rows:
        y, x = r["tile_row"] * size, r["tile_col"] * size
        out[y : y + size, x : x + size] = np.frombuffer(r["block"], "<f4").reshape(size, size, channels)
    ends = np.argwhere(~np.isnan(out).all(axis=2)).max(axis=0) + 1
    return out[: ends[0], : ends[1]]
