"""Headerless 16-bit frames: bytes to tiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_raw_files(spark: SparkSession, path: str, pattern: str = "*.raw") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def decode_raw_frames(frames: DataFrame, keys: list[str], h: int, w: int, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``content`` of little-endian uint16 rows to one tile row; the region is cut while decoding."""
    import numpy as np

    top, left, rh, rw = roi or (0, 0, h, w)

    @F.pandas_udf("array<bigint>")
    def cut(content: pd.Series) -> pd.Series:
        def one(b):
            a = np.frombuffer(b, dtype="<u2")
            if a.size != h * w:
                raise ValueError(f"frame has {a.size} pixels, expected {h * w}")
            return a.reshape(h, w)[top:top + rh, left:left + rw].astype(np.int64).ravel()
        return content.map(one)

    return frames.select(*keys, F.lit(top).alias("top"), F.lit(left).alias("left"), F.lit(rh).alias("h"), F.lit(rw).alias("w"), cut("content").alias("dn"))


def encode_raw_frames(tiles: DataFrame) -> DataFrame:
    """Tile rows to raw frame bytes (``content``), the inverse of decoding a whole frame."""
    import numpy as np

    @F.pandas_udf("binary")
    def pack(dn: pd.Series) -> pd.Series:
        return dn.map(lambda v: np.asarray(v, dtype="<u2").tobytes())

    return tiles.select("folder", "frame", pack("dn").alias("content"))
