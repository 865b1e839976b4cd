"""Frames as tiles and pixels.

Stored form: ``tiles(folder, frame, top, left, h, w, dn ARRAY<BIGINT>)`` with
row-major pixel blocks. Pixel form: ``(folder, frame, y, x, dn)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_tiles(tiles: DataFrame, colocate: bool = False, value: str = "dn") -> DataFrame:
    """One row per pixel.

    With ``colocate`` the compact tile rows are shuffled by (folder, frame) before
    the explode, so later per-frame windows and groupings need no pixel shuffle.
    """
    if colocate:
        tiles = tiles.repartition("folder", "frame")
    keep = [c for c in tiles.columns if c not in (value, "top", "left", "h", "w")]
    p = tiles.select(*keep, "top", "left", "w", F.posexplode(value).alias("_p", value))
    return p.select(
        *keep,
        (F.col("top") + F.floor(F.col("_p") / F.col("w"))).cast("bigint").alias("y"),
        (F.col("left") + F.col("_p") % F.col("w")).cast("bigint").alias("x"),
        value,
    )


def tile_pixels(pixels: DataFrame, keys: list[str], size: int, value: str = "dn") -> DataFrame:
    """Inverse of :func:`explode_tiles`: pack pixels into size x size blocks."""
    block = [F.floor(F.col("y") / size) * size, F.floor(F.col("x") / size) * size]
    packed = pixels.groupBy(*keys, block[0].cast("bigint").alias("top"), block[1].cast("bigint").alias("left")).agg(
        F.array_sort(F.collect_list(F.struct("y", "x", value))).alias("_s"),
        (F.max("y") - F.min("y") + 1).alias("h"),
        (F.max("x") - F.min("x") + 1).alias("w"),
    )
    return packed.select(*keys, "top", "left", "h", "w", F.col(f"_s.{value}").alias(value))


def pack_thumbnails(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per image of a known small size: h, w and the row-major value array."""
    g = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).cast("double").alias("v")))).alias("_s"),
        (F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))
    return g.select(*keys, "h", "w", F.col("_s.v").alias("img"))
