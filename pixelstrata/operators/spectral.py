"""Spectra and correlation functions of residual frames, by a row-column transform.

No row holds a whole image. Bands of rows are transformed along x and cut into blocks of
columns; a transposing shuffle brings the bands of a block together; blocks are transformed
along y, and their powers are added over the images of a task before anything moves again.
Real images give half a spectrum (columns 0 to w // 2); the other half is its mirror image.
Block sizes follow from the frame's shape, so a task holds about ``GROUP_VALUES`` complex
numbers of a block and one band of a frame, whatever the frame's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelstrata.functions.scalars import corr_agg, dbl, ratio, safe_div
from pixelstrata.operators.tiles import FAN_IN, PLACE, Shape, flat, frame_shape, typed

GROUP_VALUES = 1 << 20
IMAGES = 8  # images whose powers are added in one call, at least


def power_blocks(tiles: DataFrame, keys: list[str], value: str = "r", hann: bool = False, pad: int = 1, shape: Shape | None = None, index: str = "frame") -> DataFrame:
    """(keys, c0, c, n, h, w, total): powers summed over n images, in blocks of columns [c0, c0 + c) of the half spectrum.

    ``tiles`` are (keys, index, top, left, h, w, value) rows; ``pad`` = 2 appends as many zeros
    to each axis, for lags that do not wrap. All frames of a call have one shape.
    """
    shape = shape or frame_shape(tiles, index)
    height, width = shape.height, shape.width
    half = pad * width // 2 + 1
    columns = max(1, min(half, GROUP_VALUES // (IMAGES * pad * height)))
    together = max(IMAGES, GROUP_VALUES // (pad * height * columns))
    in_band = max(1, GROUP_VALUES // (shape.band * width))
    window = (np.hanning(height), np.hanning(width))
    kept = typed(tiles, keys)

    def along_x(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["left", "_i"])
        top, h = int(rows["top"].iloc[0]), int(rows["h"].iloc[0])
        strips = []
        for _, g in rows.groupby("left", sort=True):
            strips.append(np.stack([np.asarray(v, np.float64).reshape(h, int(g["w"].iloc[0])) for v in g[value]]))
        if sum(s.shape[2] for s in strips) != width or len({len(s) for s in strips}) != 1:
            raise ValueError(f"tiles at row {top} do not make whole rows of {width} pixels")
        band = np.concatenate(strips, axis=2)
        if hann:
            band = band * window[0][top : top + h, None] * window[1]
        f = np.fft.rfft(band, n=pad * width, axis=2)
        images = rows["_i"].iloc[: len(band)].to_numpy()
        starts = list(range(0, half, columns))
        out = {c: np.repeat(rows[c].iloc[0], len(band) * len(starts)) for c in keys}
        blocks = [np.ascontiguousarray(f[k, :, a : a + columns]).view(np.float64).ravel() for a in starts for k in range(len(band))]
        return pd.DataFrame({**out, "_i": np.tile(images, len(starts)), "top": top, "h": h, "c0": np.repeat(starts, len(band)), "v": blocks})

    def along_y(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["top", "_i"])
        c0 = int(rows["c0"].iloc[0])
        c = min(columns, half - c0)
        bands = [np.stack([np.asarray(v).view(np.complex128).reshape(-1, c) for v in g["v"]]) for _, g in rows.groupby("top", sort=True)]
        if sum(b.shape[1] for b in bands) != height or len({len(b) for b in bands}) != 1:
            raise ValueError(f"bands do not make whole frames of {height} rows")
        f = np.fft.fft(np.concatenate(bands, axis=1), n=pad * height, axis=1)
        norm = (window[0] ** 2).sum() * (window[1] ** 2).sum() if hann else 1.0
        total = (f.real**2 + f.imag**2).sum(0) / norm
        out = {k: [rows[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "_b": [int(rows["_b"].iloc[0])], "c0": [c0], "c": [c], "n": [len(f)], "total": [total.ravel()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.asarray(t) for t in rows["total"]], axis=0)
        head = {k: [rows[k].iloc[0]] for k in [*keys, "_b", "c0", "c"]}
        return pd.DataFrame({**head, "n": [int(rows["n"].sum())], "total": [total]})

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = (window[0] ** 2).sum() * (window[1] ** 2).sum() if hann else 1.0
        step = max(1, GROUP_VALUES // (pad * height * half))
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                images = flat(part.column(value)).reshape(-1, height, width)
                f = np.fft.rfft(images * window[0][:, None] * window[1] if hann else images, n=pad * width, axis=2)
                f = np.fft.fft(f, n=pad * height, axis=1)
                total = ((f.real**2 + f.imag**2) / norm).reshape(len(f), -1)
                offsets = np.arange(len(f) + 1, dtype=np.int32) * np.int32(total.shape[1])
                columns = [pa.array(np.full(len(f), x, np.int32)) for x in (0, half)] + [pa.array(np.ones(len(f), np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.ravel()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *columns], names=[*keys, "c0", "c", "n", "total"])

    size = [F.lit(pad * height).alias("h"), F.lit(pad * width).alias("w")]
    if shape.whole and shape.last == 0 and columns == half:  # one image of one tile to a key: nothing to bring together
        return tiles.select(*keys, value).mapInArrow(single, f"{kept}, c0 int, c int, n bigint, total array<double>").select(*keys, "c0", "c", "n", *size, "total")
    rows = tiles.select(*keys, F.col(index).cast("bigint").alias("_i"), *PLACE, value)
    lines = rows.groupBy(*keys, F.floor(F.col("_i") / in_band).alias("_g"), "top").applyInPandas(along_x, f"{kept}, _i bigint, top int, h int, c0 int, v array<double>")
    schema = f"{kept}, _b bigint, c0 int, c int, n bigint, total array<double>"
    blocks = lines.withColumn("_b", F.floor(F.col("_i") / together)).groupBy(*keys, "_b", "c0").applyInPandas(along_y, schema)
    groups = shape.last // together + 1
    while groups > 1:
        groups = -(-groups // FAN_IN)
        blocks = blocks.withColumn("_b", F.floor(F.col("_b") / FAN_IN)).groupBy(*keys, "_b", "c0").applyInPandas(add, schema)
    return blocks.select(*keys, "c0", "c", "n", *size, "total")


def _shifted(at: Column, size: Column) -> Column:
    """Place of a frequency once zero stands in the middle."""
    return F.pmod(at + F.floor(size / 2), size).cast("bigint")


def power_spectrum(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, w, v, u, power): mean power of the blocks' images, both halves, zero frequency in the middle."""
    e = blocks.select(*keys, "h", "w", "c0", "c", F.posexplode(F.transform("total", lambda t: t / F.col("n"))).alias("_p", "power"))
    v, u = F.floor(F.col("_p") / F.col("c")), F.col("c0") + F.col("_p") % F.col("c")
    two = (u > 0) & (2 * u != F.col("w"))
    mirror = F.struct(F.pmod(F.col("h") - v, F.col("h")).alias("v"), (F.col("w") - u).alias("u"))
    own = F.struct(v.alias("v"), u.cast("int").alias("u"))
    e = e.withColumn("_k", F.explode(F.when(two, F.array(own, mirror)).otherwise(F.array(own))))
    return e.select(*keys, "h", "w", _shifted(F.col("_k.v"), F.col("h")).alias("v"), _shifted(F.col("_k.u"), F.col("w")).alias("u"), "power")


def autocovariance(blocks: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """Non-circular covariance for lags up to max_lag, divided by the number of valid products, and its ACF.

    ``blocks`` come from ``power_blocks(..., pad=2)``; each gives its share of the few lags at once.
    """
    lags = np.arange(-max_lag, max_lag + 1)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for c0, c, h, w, total in zip(rows["c0"], rows["c"], rows["h"], rows["w"], rows["total"]):
                u = np.arange(c0, c0 + c)
                weight = np.where((u == 0) | (2 * u == w), 1.0, 2.0)
                ey = np.exp(2j * np.pi * np.outer(lags, np.arange(h)) / h)
                ex = np.exp(2j * np.pi * np.outer(u, lags) / w)
                out.append(((ey @ (np.asarray(total).reshape(h, c) * weight) @ ex).real / (h * w)).ravel())
            yield rows[[*keys, "n", "h", "w"]].assign(lags=out)

    s = blocks.mapInPandas(shares, typed(blocks, [*keys, "n", "h", "w"]) + ", lags array<double>")
    e = s.select(*keys, "n", "h", "w", F.posexplode("lags").alias("_p", "_t")).groupBy(*keys, "_p").agg(
        F.sum("_t").alias("_t"), F.max("n").alias("n"), F.max("h").alias("h"), F.max("w").alias("w"))
    side = 2 * max_lag + 1
    dy = (F.floor(F.col("_p") / side) - max_lag).cast("bigint")
    dx = (F.col("_p") % side - max_lag).cast("bigint")
    valid = F.col("n") * (F.col("h") / 2 - F.abs(dy)) * (F.col("w") / 2 - F.abs(dx))
    c = e.select(*keys, dy.alias("dy"), dx.alias("dx"), (F.col("_t") / valid).alias("covariance"))
    zero = F.max(F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.col("covariance"))).over(W.partitionBy(*keys))
    return c.withColumn("acf", ratio(F.col("covariance"), zero))


def acf_from_power(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, w, v, u, acf): inverse transform of the mean power over its value at lag zero; null where that is below 1e-12.

    The way back is the same: along y inside a block, a transposing shuffle to bands of rows, along x.
    """
    kept = typed(blocks, keys)

    def along_y(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                f = np.fft.ifft(np.asarray(r.total).reshape(r.h, r.c) / r.n, axis=0)
                step = max(1, GROUP_VALUES // r.w)
                starts = list(range(0, r.h, step))
                values = [np.ascontiguousarray(f[a : a + step]).view(np.float64).ravel() for a in starts]
                yield pd.DataFrame({**{k: [getattr(r, k)] * len(starts) for k in keys}, "h": r.h, "w": r.w, "c0": r.c0, "c": r.c, "top": starts, "v": values})

    def along_x(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c0")
        f = np.concatenate([np.asarray(v).view(np.complex128).reshape(-1, int(c)) for v, c in zip(rows["v"], rows["c"])], axis=1)
        a = np.fft.irfft(f, n=int(rows["w"].iloc[0]), axis=1)
        return pd.DataFrame({k: [rows[k].iloc[0]] for k in [*keys, "h", "w", "top"]} | {"acf": [a.ravel()]})

    bands = blocks.mapInPandas(along_y, f"{kept}, h int, w int, c0 int, c int, top int, v array<double>")
    back = bands.groupBy(*keys, "top").applyInPandas(along_x, f"{kept}, h int, w int, top int, acf array<double>")
    zero = F.max(F.when(F.col("top") == 0, F.get("acf", F.lit(0)))).over(W.partitionBy(*keys))
    e = back.withColumn("_z", zero).select(*keys, "h", "w", "top", "_z", F.posexplode("acf").alias("_p", "_a"))
    v, u = F.col("top") + F.floor(F.col("_p") / F.col("w")), F.col("_p") % F.col("w")
    return e.select(*keys, "h", "w", _shifted(v, F.col("h")).alias("v"), _shifted(u, F.col("w")).alias("u"), F.when(F.abs("_z") >= 1e-12, F.col("_a") / F.col("_z")).alias("acf"))


def autocovariance_summary(acf: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """Lag-1 values, anisotropy, lobes and correlation lengths of the 2-D ACF."""
    at = lambda dy, dx: F.max(F.when((F.col("dy") == dy) & (F.col("dx") == dx), F.col("acf")))
    rest = (F.col("dy") != 0) | (F.col("dx") != 0)
    g = acf.groupBy(*keys).agg(
        at(0, 1).alias("horizontal_lag1"), at(1, 0).alias("vertical_lag1"),
        F.avg(F.when((F.abs("dy") == 1) & (F.abs("dx") == 1), F.col("acf"))).alias("diagonal_lag1"),
        F.min("acf").alias("min_acf"), F.max(F.when(rest, F.col("acf"))).alias("max_nonzero_acf"),
        F.coalesce(F.max((rest & (F.col("acf") > 0.01)).cast("int")) == 1, F.lit(False)).alias("positive_lobe"),
        F.coalesce(F.max((F.col("acf") < -0.01).cast("int")) == 1, F.lit(False)).alias("negative_lobe"))
    radius = F.rint(F.sqrt(dbl(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")))).cast("bigint")
    prof = acf.groupBy(*keys, radius.alias("radius")).agg(F.avg("acf").alias("value")).where(F.col("radius") <= max_lag)
    length = lambda t: F.min(F.when((F.col("radius") > 0) & (F.abs("value") < t), F.col("radius")))
    l = prof.groupBy(*keys).agg(length(0.36787944117144233).alias("length_1e"), length(0.1).alias("length_0p1"))
    return g.withColumn("anisotropy", F.abs(F.col("horizontal_lag1") - F.col("vertical_lag1"))).join(l, keys)


def radial_average(field: DataFrame, keys: list[str], value: str, max_radius: int | None = None) -> DataFrame:
    """Mean of a centred 2-D field by integer radius, with its share of the absolute sum."""
    dy, dx = F.col("v") - F.floor(F.col("h") / 2), F.col("u") - F.floor(F.col("w") / 2)
    r = F.floor(F.sqrt(dbl(dy * dy + dx * dx))).cast("bigint")
    g = field.groupBy(*keys, r.alias("radius")).agg(F.avg(value).alias("value"))
    if max_radius is not None:
        g = g.where(F.col("radius") <= max_radius)
    return g.withColumn("share", safe_div(F.col("value"), F.sum(F.abs("value")).over(W.partitionBy(*keys))))


def frequency_radius() -> Column:
    """Radius in cycles per pixel of a shifted frequency grid."""
    fy = (F.col("v") - F.floor(F.col("h") / 2)) / F.col("h")
    fx = (F.col("u") - F.floor(F.col("w") / 2)) / F.col("w")
    return F.sqrt(fy * fy + fx * fx)


def band_fractions(field: DataFrame, keys: list[str], edges: tuple[float, float, float], value: str = "power") -> DataFrame:
    """Share of the spectrum in dc, very low, low, mid and high bands."""
    r = F.round(frequency_radius(), 9)
    v = F.col(value)
    a, b, c = edges
    part = {"dc": r == 0, "very_low": (r > 0) & (r < a), "low": (r >= a) & (r < b), "mid": (r >= b) & (r < c), "high": r >= c}
    g = field.groupBy(*keys).agg(F.sum(v).alias("_t"), *[F.sum(F.when(t, v).otherwise(0.0)).alias(k) for k, t in part.items()])
    return g.select(*keys, *[safe_div(F.col(k), F.col("_t")).alias(f"{k}_fraction") for k in part])


def correlation_length(radial: DataFrame, keys: list[str], thresholds: dict[str, float], max_radius: int) -> DataFrame:
    """First radius >= 1 at or below each threshold; max_radius + 1 with a flag when never reached."""
    g = radial.groupBy(*keys).agg(*[
        F.min(F.when((F.col("radius") >= 1) & (F.col("value") <= t), F.col("radius"))).alias(k) for k, t in thresholds.items()])
    return g.select(*keys, *[F.coalesce(k, F.lit(max_radius + 1).cast("bigint")).alias(k) for k in thresholds],
                    *[F.col(k).isNull().alias(f"{k}_censored") for k in thresholds])


def directional_psd(field: DataFrame, keys: list[str], half_width: int) -> DataFrame:
    """Horizontal, vertical and diagonal spectral profiles (band means, normalised) by index."""
    cy, cx = F.floor(F.col("h") / 2), F.floor(F.col("w") / 2)
    rows = F.array(
        F.when(F.abs(F.col("v") - cy) <= half_width, F.struct(F.lit("horizontal").alias("d"), F.col("u").alias("i"))),
        F.when(F.abs(F.col("u") - cx) <= half_width, F.struct(F.lit("vertical").alias("d"), F.col("v").alias("i"))),
        F.when(F.col("u") == F.col("v"), F.struct(F.lit("diagonal").alias("d"), F.col("v").alias("i"))))
    e = field.withColumn("_r", F.explode(F.array_compact(rows)))
    g = e.groupBy(*keys, F.col("_r.d").alias("direction"), F.col("_r.i").alias("idx")).agg(F.avg("power").alias("value"))
    w = W.partitionBy(*keys, "direction")
    return g.withColumn("normalized", F.col("value") / F.greatest(F.sum("value").over(w), F.lit(1e-12)))


def psd_flatness(field: DataFrame, keys: list[str]) -> DataFrame:
    """Geometric over arithmetic mean of the non-DC power."""
    dc = (F.col("v") == F.floor(F.col("h") / 2)) & (F.col("u") == F.floor(F.col("w") / 2))
    p = F.when(~dc, F.col("power"))
    return field.groupBy(*keys).agg((F.exp(F.avg(F.log(p + F.lit(2.2250738585072014e-308)))) / F.avg(p)).alias("flatness"))


def psd_l1(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute difference of normalised log1p radial spectra."""
    def norm(d: DataFrame, name: str) -> DataFrame:
        r = radial_average(d, keys, "power")
        l = F.log1p("value")
        return r.select(*keys, "radius", (l / F.greatest(F.sum(F.abs(l)).over(W.partitionBy(*keys)), F.lit(1e-12))).alias(name))
    j = norm(a, "a").join(norm(b, "b"), [*keys, "radius"])
    return j.groupBy(*keys).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("psd_l1"))


def spectrum_repeatability(subset_power: DataFrame, keys: list[str], edges: tuple[float, float, float]) -> DataFrame:
    """Correlation and band differences of each subset's spectrum against all frames."""
    full = subset_power.where(F.col("subset") == "all").select(*keys, "v", "u", F.col("power").alias("_f"))
    c = subset_power.join(full, [*keys, "v", "u"]).groupBy(*keys, "subset").agg(corr_agg("power", "_f").alias("spectrum_correlation"))
    b = band_fractions(subset_power, [*keys, "subset"], edges)
    bands = ["low_fraction", "mid_fraction", "high_fraction"]
    fb = b.where(F.col("subset") == "all").select(*keys, *[F.col(k).alias(f"_{k}") for k in bands])
    d = b.join(fb, keys).select(*keys, "subset", *[(F.col(k) - F.col(f"_{k}")).alias(f"{k}_difference") for k in bands])
    return c.join(d, [*keys, "subset"])
