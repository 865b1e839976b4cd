"""Distance between real and synthetic residual descriptions: strength, tail, spectrum and signal dependence.

A description belongs to a group (a condition or a variant, and one of two halves of its
frames) and has three parts: moments of the residuals, the radial profile of their mean
power spectrum, and the curve of their variance over quantile bins of the signal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelstrata.functions.ordering import exact_quantiles
from pixelstrata.functions.scalars import dbl
from pixelstrata.operators.inference import normalized_curve
from pixelstrata.operators.temporal import bias_corrected_shape
from pixelstrata.operators.tiles import Shape, flat, map_arrays, typed

FIELDS = ("strength", "tail", "spatial", "signal_nonstationarity")


@dataclass
class Description:
    """moments (keys, s, k), profile (keys, radius, share), curve (keys, bin, normalized, valid_fraction)."""

    moments: DataFrame
    profile: DataFrame
    curve: DataFrame


def residual_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sample std and bias-corrected excess kurtosis of residual rows (keys, r)."""
    g = df.groupBy(*keys).agg(F.stddev_samp("r").alias("s"), F.kurtosis("r").alias("_p"), F.count("r").alias("_n"))
    _, k = bias_corrected_shape(F.col("_n"), F.lit(0.0), F.col("_p"))
    return g.select(*keys, "s", F.when(F.col("_n") > 3, k).alias("k"))


def frame_centred(df: DataFrame, frame: list[str], value: str = "r") -> DataFrame:
    """Residuals minus the mean of their frame, so drift between frames counts neither as strength nor as tail."""
    m = df.groupBy(*frame).agg(F.avg(value).alias("_frame"))
    return df.join(m, frame).withColumn(value, F.col(value) - F.col("_frame")).drop("_frame")


def radial_share(power: DataFrame, keys: list[str], max_radius: int) -> DataFrame:
    """(keys, radius, share): mean power by whole radius from 1 to ``max_radius``, over its sum."""
    dy, dx = F.col("v") - F.floor(F.col("h") / 2), F.col("u") - F.floor(F.col("w") / 2)
    r = F.floor(F.sqrt(dbl(dy * dy + dx * dx))).cast("bigint")
    g = power.groupBy(*keys, r.alias("radius")).agg(F.avg("power").alias("_v")).where(F.col("radius").between(1, max_radius))
    return g.select(*keys, "radius", (F.col("_v") / F.greatest(F.sum("_v").over(W.partitionBy(*keys)), F.lit(1e-12))).alias("share"))


def binned_by_signal(rows: DataFrame, keys: list[str], image: list[str], signal: str, value: str, bins: int) -> DataFrame:
    """(keys, bin, normalized, valid_fraction): mean of ``value`` in quantile bins of each image's signal, averaged over images.

    Empty bins count neither in an image nor in the average; a bin that is empty in all
    images is filled from its neighbours and lowers the valid fraction.
    """
    by = [*keys, *image]
    edges = exact_quantiles(rows, by, signal, {f"_e{i}": i / bins for i in range(1, bins)})
    label = sum(((F.col(signal) >= F.col(f"_e{i}")).cast("bigint") for i in range(1, bins)), F.lit(0).cast("bigint"))
    own = rows.join(edges, by).groupBy(*by, label.alias("bin")).agg(F.avg(value).alias("_v"))
    a = own.groupBy(*keys, "bin").agg(F.avg("_v").alias("_v"))
    return normalized_curve(a, rows.select(*keys).distinct(), keys, "_v", bins).select(*keys, "bin", "normalized", "valid_fraction")


def frame_centred_tiles(tiles: DataFrame, keep: list[str], frame: list[str], shape: Shape) -> DataFrame:
    """:func:`frame_centred` on tiles (keep, r); a tile that is a whole frame stays in its task, others get one number."""
    if shape.whole:
        def level(r: np.ndarray) -> np.ndarray:
            r = r.reshape(-1, shape.height * shape.width)
            return (r - r.mean(1, keepdims=True)).ravel()

        return map_arrays(tiles, keep, ["_r"], "r", level)
    total = F.aggregate("_r", F.lit(0.0), lambda a, x: a + x)
    m = tiles.groupBy(*frame).agg((F.sum(total) / F.sum(F.size("_r"))).alias("_frame"))
    return tiles.join(m, frame).select(*keep, F.transform("_r", lambda v: v - F.col("_frame")).alias("r"))


def binned_by_map(tiles: DataFrame, labels: DataFrame, keys: list[str], image: list[str], bins: int, shape: Shape) -> DataFrame:
    """:func:`binned_by_signal` of r * r where the images of a folder have one signal, so ``labels`` (folder, top, left, bin array) hold their bins.

    A tile gives one sum for each bin; an image of one tile is averaged where it is.
    """
    names = ["n", "total"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, sizes = flat(batch.column("r")), np.asarray(batch.column("r").value_lengths())
            at = np.repeat(np.arange(len(sizes)) * bins, sizes) + flat(batch.column("bin")).astype(np.int64)
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * np.int32(bins))
            made = [np.bincount(at, weights, bins * len(sizes)).astype(np.float64) for weights in (None, r * r)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in made)], names=[*by, *names])

    by = [*keys, *image]
    joined = tiles.join(labels, ["folder", "top", "left"]).select(*by, "r", "bin")
    own = joined.mapInArrow(sums, typed(tiles, by) + ", " + ", ".join(f"{c} array<double>" for c in names))
    own = own.select(*by, F.posexplode(F.arrays_zip(*names)).alias("bin", "_p")).select(*by, F.col("bin").cast("bigint").alias("bin"), "_p.n", "_p.total")
    if not shape.whole:
        own = own.groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in names])
    a = own.where("n > 0").groupBy(*keys, "bin").agg(F.avg(F.col("total") / F.col("n")).alias("_v"))
    return normalized_curve(a, tiles.select(*keys).distinct(), keys, "_v", bins).select(*keys, "bin", "normalized", "valid_fraction")


def signal_bins(pixels: DataFrame, signal: str, bins: int) -> DataFrame:
    """(folder, top, left, signal array, bin array) from the pixels (folder, place, at, signal) of one map a folder."""
    edges = exact_quantiles(pixels, ["folder"], signal, {f"_e{i}": i / bins for i in range(1, bins)})
    label = sum(((F.col(signal) >= F.col(f"_e{i}")).cast("bigint") for i in range(1, bins)), F.lit(0).cast("bigint"))
    g = pixels.join(edges, "folder").groupBy("folder", "top", "left").agg(F.array_sort(F.collect_list(F.struct("at", signal, label.alias("bin")))).alias("_s"))
    return g.select("folder", "top", "left", F.col(f"_s.{signal}").alias(signal), F.col("_s.bin").alias("bin"))


def mismatch_metrics(real: Description, synthetic: Description) -> DataFrame:
    """One row per folder, variant and half, with the four distances and what they are made of.

    strength: |log ratio of standard deviations|; tail: difference of kurtosis; spatial: mean
    absolute difference of radial profiles; signal_nonstationarity: of the conditional curves
    on bins that both have. Keys are (folder, half) and (variant, half).
    """
    b = synthetic.moments.withColumnsRenamed({"s": "_s", "k": "_k"})
    floor = F.lit(1e-12)
    base = real.moments.join(b, "half").select(
        "folder", "variant", "half", F.abs(F.log(F.greatest("s", floor) / F.greatest("_s", floor))).alias("strength"),
        F.abs(F.col("k") - F.col("_k")).alias("tail"), F.col("s").alias("real_std"), F.col("_s").alias("synthetic_std"), F.col("k").alias("real_kurtosis"), F.col("_k").alias("synthetic_kurtosis"))
    cell = ["folder", "variant", "half"]
    l1 = lambda a, b: F.avg(F.abs(F.col(a) - F.col(b)))
    spatial = real.profile.join(synthetic.profile.withColumnRenamed("share", "_share"), ["half", "radius"]).groupBy(*cell).agg(l1("share", "_share").alias("spatial"))
    other = synthetic.curve.withColumnsRenamed({"normalized": "_normalized", "valid_fraction": "synthetic_valid_fraction"})
    curve = real.curve.withColumnRenamed("valid_fraction", "real_valid_fraction").join(other, ["half", "bin"]).groupBy(*cell).agg(
        l1("normalized", "_normalized").alias("signal_nonstationarity"), F.max("real_valid_fraction").alias("real_valid_fraction"), F.max("synthetic_valid_fraction").alias("synthetic_valid_fraction"))
    return base.join(spatial, cell, "left").join(curve, cell, "left")


def mismatch_aggregate(metrics: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Mean over halves and the two halves side by side."""
    half = lambda m, h: F.avg(F.when(F.col("half") == h, F.col(m)))
    return metrics.groupBy(*keys).agg(*[e for m in fields for e in (F.avg(m).alias(m), half(m, "A").alias(f"{m}_a"), half(m, "B").alias(f"{m}_b"))])
