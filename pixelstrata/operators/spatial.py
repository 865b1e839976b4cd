"""Stencils and neighbourhood statistics inside one image.

Images are (keys, y, x, value) rows. Row and column windows are partitioned by
image and line, so one task sees one line at a time, never a whole folder.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelstrata.functions.scalars import clip, corr_agg, dbl, let, ratio


def row_window(keys: list[str]):
    return W.partitionBy(*keys, "y").orderBy("x")


def col_window(keys: list[str]):
    return W.partitionBy(*keys, "x").orderBy("y")


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) of a normalised Gaussian cut at ``truncate`` sigma."""
    radius = int(truncate * sigma + 0.5)
    raw = [(k, math.exp(-0.5 * (k / sigma) ** 2)) for k in range(-radius, radius + 1)]
    total = sum(w for _, w in raw)
    return [(k, w / total) for k, w in raw]


def convolve_axis(df: DataFrame, keys: list[str], axis: str, value: str, kernel: list[tuple[int, float]]) -> DataFrame:
    """Correlate every line with ``kernel``; borders repeat the edge sample and reflect."""
    other = "x" if axis == "y" else "y"
    line = df.groupBy(*keys, other).agg(
        F.array_sort(F.collect_list(F.struct(axis, dbl(value).alias("v")))).alias("_l")
    )

    def tap(v: Column, n: Column, i: Column, k: int) -> Column:
        j = F.pmod(i + F.lit(k), 2 * n)
        return F.element_at(v, (F.when(j >= n, 2 * n - 1 - j).otherwise(j) + 1).cast("int"))

    def smooth(v: Column, n: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k, w in kernel:
            total = total + F.lit(w) * tap(v, n, i, k)
        return total

    n = F.size("_l")
    out = line.withColumn("_o", let(
        F.col("_l.v"), lambda v: F.transform(F.sequence(F.lit(0), n - 1), lambda i: smooth(v, F.size(v), i))))
    ex = out.select(*keys, other, F.posexplode("_o").alias("_p", "_s"), "_l")
    return ex.select(
        *keys,
        *([F.element_at("_l", F.col("_p") + 1)["y"].alias("y"), F.col("x")] if axis == "y"
          else [F.col("y"), F.element_at("_l", F.col("_p") + 1)["x"].alias("x")]),
        F.col("_s").alias(value),
    )


def gaussian_blur(df: DataFrame, keys: list[str], value: str, sigma: float) -> DataFrame:
    k = gaussian_kernel(sigma)
    return convolve_axis(convolve_axis(df.select(*keys, "y", "x", value), keys, "y", value, k), keys, "x", value, k)


def gaussian_highpass(df: DataFrame, keys: list[str], value: str, sigma: float, out: str = "hp") -> DataFrame:
    """value - Gaussian blur of the value."""
    low = gaussian_blur(df, keys, value, sigma).withColumnRenamed(value, "_low")
    return df.join(low, [*keys, "y", "x"]).withColumn(out, dbl(value) - F.col("_low")).drop("_low")


def box_sums(df: DataFrame, keys: list[str], cols: dict[str, Column], radius: int) -> DataFrame:
    """Sums of each column over a (2r+1)^2 window, interior pixels only."""
    for name, c in cols.items():
        df = df.withColumn(name, c)
    wx = row_window(keys).rowsBetween(-radius, radius)
    wy = col_window(keys).rowsBetween(-radius, radius)
    df = df.select("*", *[F.sum(n).over(wx).alias(f"_{n}") for n in cols], F.count(F.lit(1)).over(wx).alias("_cx"))
    df = df.where(F.col("_cx") == 2 * radius + 1)
    df = df.select(
        *[c for c in df.columns if not c.startswith("_")],
        *[F.sum(f"_{n}").over(wy).alias(f"box_{n}") for n in cols],
        F.count(F.lit(1)).over(wy).alias("_cy"),
    )
    return df.where(F.col("_cy") == 2 * radius + 1).drop("_cy", *cols)


def box_filter(df: DataFrame, keys: list[str], value: str, radius: int = 3) -> DataFrame:
    """Local mean and population std over a square window (interior pixels)."""
    n = float((2 * radius + 1) ** 2)
    v = dbl(value)
    s = box_sums(df, keys, {"s1": v, "s2": v * v}, radius)
    mean = F.col("box_s1") / n
    return s.select(
        *keys, "y", "x", mean.alias("local_mean"),
        F.sqrt(F.greatest(F.col("box_s2") / n - mean * mean, F.lit(0.0))).alias("local_std"),
    )


def laplacian(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """5-point Laplacian with the edge sample repeated."""
    v = dbl(value)
    rx, cy = row_window(keys), col_window(keys)
    near = [F.coalesce(f(v, 1).over(w), v) for w in (rx, cy) for f in (F.lag, F.lead)]
    return df.withColumn("lap", near[0] + near[1] + near[2] + near[3] - 4 * v)


def central_gradient(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """gy, gx and magnitude: central differences inside, one-sided at the border."""
    v = dbl(value)

    def axis(w) -> Column:
        before, after = F.lag(v, 1).over(w), F.lead(v, 1).over(w)
        return F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)

    g = df.withColumn("gx", axis(row_window(keys))).withColumn("gy", axis(col_window(keys)))
    return g.withColumn("grad", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def forward_differences(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """dx, dy to the right and lower neighbour (NULL on the last column or row)."""
    v = dbl(value)
    return df.withColumn("dx", F.lead(v, 1).over(row_window(keys)) - v).withColumn(
        "dy", F.lead(v, 1).over(col_window(keys)) - v
    )


def sobel(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sobel / 8 gradient magnitude with the edge sample repeated."""
    v = dbl(value)
    rx, cy = row_window(keys), col_window(keys)
    up, down = F.coalesce(F.lag(v, 1).over(cy), v), F.coalesce(F.lead(v, 1).over(cy), v)
    s = df.withColumn("_sy", up + 2 * v + down).withColumn("_dy", down - up)
    left, right = F.coalesce(F.lag("_sy", 1).over(rx), F.col("_sy")), F.coalesce(F.lead("_sy", 1).over(rx), F.col("_sy"))
    dl, dr = F.coalesce(F.lag("_dy", 1).over(rx), F.col("_dy")), F.coalesce(F.lead("_dy", 1).over(rx), F.col("_dy"))
    s = s.withColumn("_gx", (right - left) / 8).withColumn("_gy", (dl + 2 * F.col("_dy") + dr) / 8)
    return s.withColumn("sobel", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).drop(
        "_sy", "_dy", "_gx", "_gy"
    )


def lag1_correlation(df: DataFrame, keys: list[str], value: str, group: list[str]) -> DataFrame:
    """Horizontal, vertical, diagonal and anti-diagonal neighbour correlation per group."""
    v = dbl(value)
    rx, cy = row_window(keys), col_window(keys)
    n = df.withColumn("_h", F.lead(v, 1).over(rx)).withColumn("_v", F.lead(v, 1).over(cy))
    n = n.withColumn("_d", F.lead("_h", 1).over(cy))
    # the pixel below (x-1): taken from the row below's left neighbour
    n = n.withColumn("_l", F.lag(v, 1).over(rx)).withColumn("_a", F.lead("_l", 1).over(cy))
    return n.groupBy(*group).agg(
        corr_agg(v, "_h").alias("horizontal"), corr_agg(v, "_v").alias("vertical"),
        corr_agg(v, "_d").alias("diagonal"), corr_agg(v, "_a").alias("anti_diagonal"),
    )


def block_mean(df: DataFrame, keys: list[str], value: str, factor: int) -> DataFrame:
    """Average over factor x factor blocks."""
    return df.groupBy(
        *keys, F.floor(F.col("y") / factor).cast("bigint").alias("y"), F.floor(F.col("x") / factor).cast("bigint").alias("x")
    ).agg(F.avg(value).alias(value))


def ssim_window_map(df: DataFrame, keys: list[str], a: str, b: str, data_range: float, radius: int = 3) -> DataFrame:
    """Structural similarity of a and b in uniform windows, interior pixels."""
    n = float((2 * radius + 1) ** 2)
    va, vb = dbl(a), dbl(b)
    s = box_sums(df, keys, {"a": va, "b": vb, "aa": va * va, "bb": vb * vb, "ab": va * vb}, radius)
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    ma, mb = F.col("box_a") / n, F.col("box_b") / n
    unbias = n / (n - 1)
    saa = unbias * (F.col("box_aa") / n - ma * ma)
    sbb = unbias * (F.col("box_bb") / n - mb * mb)
    sab = unbias * (F.col("box_ab") / n - ma * mb)
    score = ((2 * ma * mb + c1) * (2 * sab + c2)) / ((ma * ma + mb * mb + c1) * (saa + sbb + c2))
    return s.select(*keys, "y", "x", score.alias("ssim"))


def normalized(c, data_range: float) -> Column:
    return clip(dbl(c) / F.lit(float(data_range)), 0.0, 1.0)


def curve_share(value, total) -> Column:
    return ratio(value, total)
