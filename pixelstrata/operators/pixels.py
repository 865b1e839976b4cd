"""Row-wise pixel operators: crops, strides, coordinate changes, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelstrata.functions.scalars import array_sum, clip, dbl, let


def hex_number(hash_text: Column, start: int, digits: int) -> Column:
    """Integer value of hex digits of a hash (at most 15)."""
    return F.conv(F.substring(hash_text, start, digits), 16, 10).cast("bigint")


def crop_center(pixels: DataFrame, h: int, w: int, size: int) -> DataFrame:
    """Centred square region, limited to the image; the box is kept in columns."""
    s = min(size, h, w)
    top, left = (h - s) // 2, (w - s) // 2
    inside = (F.col("y") >= top) & (F.col("y") < top + s) & (F.col("x") >= left) & (F.col("x") < left + s)
    return pixels.where(inside).withColumns({
        "crop_top": F.lit(top).cast("bigint"), "crop_left": F.lit(left).cast("bigint"), "crop_size": F.lit(s).cast("bigint")})


def crop_rois(pixels: DataFrame, rois: dict[str, tuple[int, int, int, int]]) -> DataFrame:
    """Every pixel once per named (top, left, height, width) region it lies in."""
    y, x = F.col("y"), F.col("x")
    hit = [F.when((y >= t) & (y < t + h) & (x >= le) & (x < le + w), F.lit(n)) for n, (t, le, h, w) in rois.items()]
    return pixels.withColumn("roi", F.explode(F.array_compact(F.array(*hit))))


def patch_corner(key_hash: Column, h: int, w: int, size: int) -> tuple[Column, Column]:
    """Even (top, left) of a patch, chosen by the key's hash."""
    top = 2 * (hex_number(key_hash, 1, 8) % ((h - size) // 2 + 1))
    left = 2 * (hex_number(key_hash, 9, 8) % ((w - size) // 2 + 1))
    return top, left


def crop_patch(pixels: DataFrame, key_hash: Column, h: int, w: int, size: int) -> DataFrame:
    """The same hash-chosen patch of all images sharing a key."""
    top, left = patch_corner(key_hash, h, w, size)
    d = pixels.withColumn("patch_top", top).withColumn("patch_left", left)
    y, x = F.col("y") - F.col("patch_top"), F.col("x") - F.col("patch_left")
    return d.where((y >= 0) & (y < size) & (x >= 0) & (x < size))


def pixel_stride(pixels: DataFrame, k: int) -> DataFrame:
    """Every k-th row and column."""
    return pixels.where((F.col("y") % k == 0) & (F.col("x") % k == 0))


def normalize_clip(c, range_max: float) -> Column:
    return clip(dbl(c) / range_max, 0.0, 1.0)


def augment_coords(pixels: DataFrame, key_hash: Column, n: int) -> DataFrame:
    """Hash-chosen flips and quarter turns of n x n images, as a coordinate remap."""
    code = hex_number(key_hash, 1, 4) % 16
    d = pixels.withColumn("turns", code % 4).withColumn("flip_x", F.floor(code / 4) % 2).withColumn("flip_y", F.floor(code / 8) % 2)
    y, x, m, k = F.col("y"), F.col("x"), n - 1, F.col("turns")
    ry = F.when(k == 0, y).when(k == 1, m - x).when(k == 2, m - y).otherwise(x)
    rx = F.when(k == 0, x).when(k == 1, y).when(k == 2, m - x).otherwise(m - y)
    d = d.withColumn("_y", ry).withColumn("_x", rx)
    return d.withColumn("y", F.when(F.col("flip_y") == 1, m - F.col("_y")).otherwise(F.col("_y"))).withColumn(
        "x", F.when(F.col("flip_x") == 1, m - F.col("_x")).otherwise(F.col("_x"))).drop("_y", "_x")


def channel_layout(df: DataFrame, keys: list[str], dims: str, values: str) -> DataFrame:
    """(band, y, x, value) from flat arrays laid out HxW, CxHxW (leading 1 or 3) or HxWxC."""
    d0, d1, d2 = (F.element_at(dims, i) for i in (1, 2, 3))
    two = F.size(dims) == 2
    chw = ~two & d0.isin(1, 3)
    e = df.select(*keys, dims, F.posexplode(values).alias("p", "value"))
    p = F.col("p")
    third = F.coalesce(F.try_element_at(dims, F.lit(3)), F.lit(1))
    band = F.when(two, F.lit(0)).when(chw, F.floor(p / (d1 * third))).otherwise(p % third)
    y = F.when(two, F.floor(p / d1)).when(chw, F.floor(p / third) % d1).otherwise(F.floor(p / (d1 * third)))
    x = F.when(two, p % d1).when(chw, p % third).otherwise(F.floor(p / third) % d1)
    return e.select(*keys, band.cast("bigint").alias("band"), y.cast("bigint").alias("y"), x.cast("bigint").alias("x"), "value")


def thumbnail_robust(pixels: DataFrame, keys: list[str], stride: int, lo: float, hi: float, value: str = "dn") -> DataFrame:
    """Unit vectors: strided image stretched between percentiles, mean removed, normalised."""
    d = pixel_stride(pixels, stride)
    q = F.percentile(value, F.array(F.lit(lo), F.lit(hi)))
    # the whole (small) thumbnail stays one array row from here on
    g = d.groupBy(*keys).agg(q.alias("_q"), F.array_sort(F.collect_list(F.struct("y", "x", dbl(value).alias("v")))).alias("_s"))
    stretch = lambda v, a, b: F.least(F.greatest((v - a) / F.greatest(b - a, F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))
    limits = lambda v: F.transform(v, lambda e: stretch(e, F.element_at("_q", 1), F.element_at("_q", 2)))
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)), F.lit(1e-12))
    unit = lambda v: let(norm(v), lambda q: F.transform(v, lambda e: e / q))
    centre = lambda v: let(array_sum(v) / F.size(v), lambda m: let(F.transform(v, lambda e: e - m), unit))
    return g.select(*keys, let(limits(F.col("_s.v")), centre).alias("vec"))
