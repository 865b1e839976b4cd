"""Quality of image pairs: (keys, y, x, clean, noisy) rows, raw 16-bit values.

Per-pair reductions are single partial aggregations; windows run per image line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelstrata.functions.ordering import average_rank, exact_quantiles
from pixelstrata.functions.scalars import (
    clip, corr_agg, corr_from_moments, dbl, finite, flag_list, psnr_from_mse, ratio, safe_div,
)
from pixelstrata.operators.spatial import (
    box_sums, central_gradient, forward_differences, sobel, ssim_window_map,
)
from pixelstrata.operators.temporal import profiles, temporal_residual

PAIR = ["pair_key"]


def odd_even_pairs(pixels: DataFrame) -> DataFrame:
    """Every even frame against the integer mean of the odd frames of its folder."""
    clean = pixels.where(F.col("frame") % 2 == 1).groupBy("folder", "y", "x").agg(
        F.floor(F.sum("dn") / F.count(F.lit(1))).cast("bigint").alias("clean"))
    noisy = pixels.where(F.col("frame") % 2 == 0).withColumnRenamed("dn", "noisy")
    key = F.concat(F.lit("folder_"), F.col("folder").cast("string"), F.lit("_frame_"), F.col("frame").cast("string"))
    return noisy.join(clean, ["folder", "y", "x"]).select(key.alias("pair_key"), "folder", "frame", "y", "x", "clean", "noisy")


def odd_even_tiles(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`odd_even_pairs` as tiles: (folder, frame, place, noisy) of even frames and (folder, place, at, clean) of the pixels of the maps."""
    place = ["top", "left", "h", "w"]
    odd = tiles.where(F.col("frame") % 2 == 1).select("folder", *place, F.posexplode("dn").alias("at", "dn"))
    clean = odd.groupBy("folder", *place, "at").agg(F.floor(F.sum("dn") / F.count(F.lit(1))).cast("bigint").alias("clean"))
    return tiles.where(F.col("frame") % 2 == 0).select("folder", "frame", *place, F.col("dn").alias("noisy")), clean


def surrogate_pairs(pixels: DataFrame, reference_share: float = 0.5, stride: int = 1) -> DataFrame:
    """Mean of the leading frames as clean, strided later frames as noisy."""
    n = pixels.groupBy("folder").agg(F.floor(F.max("frame") * reference_share).alias("_ref"))
    p = pixels.join(n, "folder")
    clean = p.where(F.col("frame") <= F.col("_ref")).groupBy("folder", "y", "x").agg(F.avg("dn").alias("clean"))
    held = p.where((F.col("frame") > F.col("_ref")) & ((F.col("frame") - F.col("_ref") - 1) % stride == 0))
    key = F.concat(F.lit("folder_"), F.col("folder").cast("string"), F.lit("_frame_"), F.col("frame").cast("string"))
    return held.join(clean, ["folder", "y", "x"]).select(
        key.alias("pair_key"), "folder", "frame", "y", "x", F.rint("clean").cast("bigint").alias("clean"),
        F.col("dn").alias("noisy"), F.col("_ref").alias("reference_frames"))


def psnr(df: DataFrame, keys: list[str], pred: str, target: str, data_range: float) -> DataFrame:
    """PSNR per image; also counts pixels present on one side only (shape mismatch)."""
    d = dbl(pred) - dbl(target)
    missing = F.sum((F.col(pred).isNull() | F.col(target).isNull()).cast("bigint")).alias("unmatched")
    return df.groupBy(*keys).agg(F.avg(d * d).alias("mse"), missing).withColumn("psnr", psnr_from_mse("mse", data_range))


def ssim_score(ma: Column, mb: Column, va: Column, vb: Column, cov: Column, data_range: float) -> Column:
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def ssim_global_agg(a, b, data_range: float) -> Column:
    """One-window SSIM as an aggregate expression."""
    x, y = dbl(a), dbl(b)
    return ssim_score(F.avg(x), F.avg(y), F.var_pop(x), F.var_pop(y), F.covar_pop(x, y), data_range)


def ssim_windowed(df: DataFrame, keys: list[str], a: str, b: str, data_range: float, radius: int = 3) -> DataFrame:
    """Mean windowed SSIM over the interior of each image."""
    return ssim_window_map(df, keys, a, b, data_range, radius).groupBy(*keys).agg(F.avg("ssim").alias("ssim"))


def residual_aggs(res: Column) -> list[Column]:
    return [
        F.avg(res).alias("residual_mean"), F.stddev_pop(res).alias("residual_std"), F.var_pop(res).alias("residual_var"),
        F.avg(F.abs(res)).alias("residual_mae"),
    ]


def residual_stats(df: DataFrame, keys: list[str], pred: str, target: str) -> DataFrame:
    """Residual moments and p1/50/99 (16-bit differences: bounded distinct values)."""
    r = F.col(pred) - F.col(target)
    p = F.percentile(r, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    out = df.groupBy(*keys).agg(*residual_aggs(r), p.alias("_p"))
    return out.select("*", *[F.element_at("_p", i).alias(n) for i, n in ((1, "p01"), (2, "p50"), (3, "p99"))]).drop("_p")


def bin_of(v: Column, bins: int, data_range: float) -> Column:
    """Equal-width bin of [0, range]; last bin closed."""
    return F.when((v >= 0) & (v <= data_range), F.least(F.floor(v * bins / F.lit(float(data_range))), F.lit(bins - 1))).cast("bigint")


def all_bins(df: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Every key with every bin number, so that empty bins stay visible."""
    return df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))


def intensity_residual_bins(df: DataFrame, keys: list[str], pred: str, target: str, bins: int, data_range: float) -> DataFrame:
    """Residual count, mean, variance by clean intensity; empty bins kept."""
    r = dbl(pred) - dbl(target)
    b = df.withColumn("bin", bin_of(F.col(target), bins, data_range))
    agg = b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n"), F.avg(r).alias("mean"), F.var_pop(r).alias("var"), F.avg(r * r).alias("mse"))
    width = data_range / bins
    return all_bins(df, keys, bins).join(agg, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("bin") * width).alias("bin_low"), ((F.col("bin") + 1) * width).alias("bin_high"),
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("count"), "mean", "var", "mse")


def brightness_bin_psnr(df: DataFrame, keys: list[str], pred: str, target: str, bins: int, data_range: float) -> DataFrame:
    return intensity_residual_bins(df, keys, pred, target, bins, data_range).withColumn("psnr", psnr_from_mse("mse", data_range))


def image_quality(df: DataFrame, keys: list[str], pred: str, target: str, data_range: float) -> DataFrame:
    """psnr, windowed ssim, residual mean/std/mae, one row per image."""
    r = dbl(pred) - dbl(target)
    base = df.groupBy(*keys).agg(F.avg(r * r).alias("mse"), *residual_aggs(r)).withColumn("psnr", psnr_from_mse("mse", data_range))
    return base.join(ssim_windowed(df, keys, pred, target, data_range), keys).select(
        *keys, "psnr", "ssim", "residual_mean", "residual_std", "residual_mae")


def pair_baseline_summary(quality: DataFrame, group: list[str]) -> DataFrame:
    cols = ["psnr", "ssim", "residual_mean", "residual_std", "residual_mae"]
    return quality.groupBy(*group).agg(
        F.count(F.lit(1)).alias("pairs"),
        *[f(finite(c)).alias(f"{c}_{n}") for c in cols for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def valid_mask(pairs: DataFrame, bad: DataFrame, range_max: int) -> DataFrame:
    """Adds ``valid``: not a bad pixel and strictly inside (0, range) on both images."""
    c = F.col
    inside = (c("clean") > 0) & (c("noisy") > 0) & (c("clean") < range_max) & (c("noisy") < range_max)
    return pairs.join(bad.select("folder", "y", "x", "bad"), ["folder", "y", "x"], "left").withColumn(
        "valid", inside & ~F.coalesce("bad", F.lit(False))).drop("bad")


def masked_quality(df: DataFrame, keys: list[str], data_range: float) -> DataFrame:
    """Quality over valid pixels only, next to the full-image PSNR."""
    v = F.col("valid")
    r, d2 = F.col("noisy") - F.col("clean"), (dbl("noisy") - dbl("clean")) ** 2
    on = lambda e: F.when(v, e)
    p = F.percentile(on(r), F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    g = df.groupBy(*keys).agg(
        F.avg(v.cast("double")).alias("valid_fraction"), F.avg(d2).alias("_full"), F.avg(on(d2)).alias("_mse"),
        F.avg(on(F.abs(r))).alias("mae_masked"), F.avg(on(F.col("clean"))).alias("clean_mean"),
        F.avg(on(F.col("noisy"))).alias("noisy_mean"), F.avg(on(r)).alias("residual_mean"),
        F.stddev_samp(on(r)).alias("residual_std"), p.alias("_p"))
    return g.select(
        *keys, "valid_fraction", psnr_from_mse("_full", data_range).alias("psnr_full"),
        psnr_from_mse("_mse", data_range).alias("psnr_masked"), "mae_masked", "clean_mean", "noisy_mean",
        safe_div("noisy_mean", "clean_mean").alias("mean_ratio"), "residual_mean", "residual_std",
        *[F.element_at("_p", i).alias(n) for i, n in ((1, "p01"), (2, "p50"), (3, "p99"))])


def dark_correct_fill(df: DataFrame, keys: list[str], raw: str, dark: str, valid: str, data_range: float) -> DataFrame:
    """(raw - dark) / range clipped; invalid pixels get the median of the image's valid ones."""
    # integer difference first: the median buffer stays bounded by the value range
    diff = F.least(F.greatest(F.col(raw) - F.col(dark), F.lit(0)), F.lit(int(data_range)))
    med = df.groupBy(*keys).agg(F.percentile(F.when(F.col(valid), diff), 0.5).alias("_med"))
    return df.join(med, keys).withColumn(
        "corrected", F.when(F.col(valid), dbl(diff)).otherwise(F.col("_med")) / data_range).drop("_med")


def scale_to_p99(df: DataFrame, keys: list[str], value: str, valid: str, target: float, data_range: float) -> DataFrame:
    """Scale each image so that the p99 of its valid pixels reaches the target share of the range."""
    p = df.groupBy(*keys).agg((F.percentile(F.when(F.col(valid), F.col(value)), 0.99) / data_range).alias("_p99"))
    scale = F.when((F.lit(target) > 0) & (F.col("_p99") > 1e-12), F.lit(target) / F.col("_p99")).otherwise(F.lit(1.0))
    return df.join(p, keys).withColumn("scale", scale).withColumn(
        "scaled", clip(dbl(value) / data_range * F.col("scale"), 0.0, 1.0)).drop("_p99")


def scale_to_mean_u16(df: DataFrame, keys: list[str], value: str, target: float, range_max: int) -> DataFrame:
    """Scale to a target mean, quantise to 16 bit and report what that did to each image."""
    m = df.groupBy(*keys).agg(F.avg(value).alias("source_mean"))
    s = df.join(m, keys).withColumn("_g", F.lit(float(target)) / F.col("source_mean")).withColumn(
        "_f", dbl(value) * F.col("_g")).withColumn("_q", F.rint(clip("_f", 0, range_max)).cast("bigint"))
    pct = F.percentile("_q", F.array(F.lit(0.01), F.lit(0.99)))
    g = s.groupBy(*keys, "source_mean", F.col("_g").alias("gain")).agg(
        F.avg("_q").alias("scaled_mean"), F.avg((F.col(value) == 0).cast("double")).alias("source_zero_ratio"),
        F.avg((F.col("_q") == 0).cast("double")).alias("scaled_zero_ratio"),
        F.avg((F.col("_q") == range_max).cast("double")).alias("clipping_high_ratio"),
        F.count_distinct("_q").alias("unique_values"), F.stddev_pop("_q").alias("scaled_std"), pct.alias("_p"),
        F.max(F.abs(F.col("_f") - F.col("_q"))).alias("round_trip_max_error"))
    return g.select(
        *keys, "source_mean", "gain", "scaled_mean",
        (F.abs(F.col("scaled_mean") - target) / target).alias("relative_mean_error"), "source_zero_ratio", "scaled_zero_ratio",
        F.greatest(F.lit(0.0), F.col("scaled_zero_ratio") - F.col("source_zero_ratio")).alias("added_zero_ratio"),
        "clipping_high_ratio", "unique_values", "scaled_std",
        (F.element_at("_p", 2) - F.element_at("_p", 1)).alias("dynamic_range"), "round_trip_max_error")


def rescale_residual(df: DataFrame, keys: list[str], target_std: str, lo: float, hi: float, data_range: float) -> DataFrame:
    """Zero-mean residual multiplied so its std meets the target; factor limited to [lo, hi]."""
    r = F.col("noisy") - F.col("clean")
    g = df.groupBy(*keys).agg(F.avg(r).alias("_m"), F.stddev_samp(r).alias("base_std"))
    j = df.join(g, keys)
    factor = F.when(F.col("base_std") <= 1e-12, F.lit(1.0)).otherwise(F.col(target_std) / F.greatest("base_std", F.lit(1e-12)))
    j = j.withColumn("scale", clip(factor, lo, hi))
    return j.withColumn("rescaled", clip((dbl("clean") + (r - F.col("_m")) * F.col("scale")) / data_range, 0.0, 1.0)).drop("_m")


def u16_round_trip(df: DataFrame, keys: list[str], value: str, range_max: int) -> DataFrame:
    """Error of quantising a [0, 1] image to 16 bit and back."""
    q = F.rint(clip(value, 0, 1) * range_max)
    back = q / range_max
    g = df.groupBy(*keys).agg(
        F.max(F.abs(back - F.col(value))).alias("max_error"),
        F.stddev_pop(value).alias("_sv"), F.stddev_pop(back).alias("_sb"),
        (F.avg((q == 0).cast("double")) - F.avg((F.col(value) == 0).cast("double"))).alias("zero_ratio_change"),
        (F.avg((q == range_max).cast("double")) - F.avg((F.col(value) == 1).cast("double"))).alias("one_ratio_change"))
    return g.withColumn("std_error", F.abs(F.col("_sb") - F.col("_sv"))).drop("_sv", "_sb")


def prediction_quality(pred: DataFrame, keys: list[str], data_range: float) -> DataFrame:
    """Prediction and noisy input against the reference: quality, gains, sharpness, bias."""
    q = image_quality(pred, keys, "value", "clean", data_range)
    n = image_quality(pred, keys, "noisy", "clean", data_range).select(
        *keys, F.col("psnr").alias("noisy_psnr"), F.col("ssim").alias("noisy_ssim"))
    gv = central_gradient(pred, keys, "value").groupBy(*keys).agg(F.avg("grad").alias("_gv"))
    gn = central_gradient(pred, keys, "noisy").groupBy(*keys).agg(F.avg("grad").alias("_gn"))
    rest = pred.groupBy(*keys).agg(
        F.stddev_pop(F.col("noisy") - F.col("value")).alias("removed_std"), F.avg(F.col("value") - F.col("clean")).alias("brightness_bias"))
    return (
        q.join(n, keys).join(gv, keys).join(gn, keys).join(rest, keys)
        .withColumn("psnr_gain", F.col("psnr") - F.col("noisy_psnr")).withColumn("ssim_gain", F.col("ssim") - F.col("noisy_ssim"))
        .withColumn("gradient_ratio", ratio("_gv", "_gn")).drop("_gv", "_gn"))


def blend_alpha(kind: str, score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Blend weight of a strategy: constant (low), hard threshold (low) or linear ramp low..high."""
    if kind == "constant":
        return F.lit(float(low))
    if kind == "hard":
        return (score >= low).cast("double")
    if kind == "linear":
        return clip((score - low) / max(high - low, 1e-12), 0.0, 1.0)
    raise ValueError(f"unknown blend {kind}")


def blend_strategies(df: DataFrame, a: str, b: str, alphas: dict[str, Column], data_range: float) -> DataFrame:
    """One row per pixel and strategy: (1 - alpha) * a + alpha * b, clipped to the range."""
    arr = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("a")) for k, v in alphas.items()])
    e = df.withColumn("_s", F.explode(arr)).withColumn("blend", F.col("_s.k")).withColumn("alpha", F.col("_s.a")).drop("_s")
    return e.withColumn("blended", clip((1 - F.col("alpha")) * dbl(a) + F.col("alpha") * dbl(b), 0, data_range))


def histogram_l1(df: DataFrame, keys: list[str], a: str, b: str, bins: int, floor_halfwidth: float) -> DataFrame:
    """L1 distance between shared-bin histograms of two residual columns.

    Edges: extreme percentiles (0.5 / 99.5) of both, at least +-floor_halfwidth.
    """
    pct = lambda c: F.percentile(c, F.array(F.lit(0.005), F.lit(0.995)))
    e = df.groupBy(*keys).agg(pct(a).alias("_a"), pct(b).alias("_b"))
    at = F.element_at
    e = e.select(*keys, F.least(at("_a", 1), at("_b", 1), F.lit(-floor_halfwidth)).alias("_lo"),
                 F.greatest(at("_a", 2), at("_b", 2), F.lit(floor_halfwidth)).alias("_hi"))
    both = F.array(F.struct(F.lit(0).alias("s"), dbl(a).alias("v")), F.struct(F.lit(1).alias("s"), dbl(b).alias("v")))
    x = df.join(e, keys).withColumn("_e", F.explode(both)).where((F.col("_e.v") >= F.col("_lo")) & (F.col("_e.v") <= F.col("_hi")))
    bin_no = F.least(F.floor((F.col("_e.v") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    h = x.groupBy(*keys, bin_no.alias("bin")).agg(
        F.sum((F.col("_e.s") == 0).cast("bigint")).alias("ca"), F.sum((F.col("_e.s") == 1).cast("bigint")).alias("cb"))
    t = h.groupBy(*keys).agg(F.sum("ca").alias("_ta"), F.sum("cb").alias("_tb"))
    return h.join(t, keys).groupBy(*keys).agg(
        F.sum(F.abs(F.col("ca") / F.greatest("_ta", F.lit(1)) - F.col("cb") / F.greatest("_tb", F.lit(1)))).alias("histogram_l1"))


def residual_histogram(df: DataFrame, keys: list[str], value: Column, lo: float, width: float, bins: int) -> DataFrame:
    """Fixed-width histogram with under- and overflow in the outer bins."""
    b = F.least(F.greatest(F.floor((value - lo) / width), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def prior_fidelity(pred: DataFrame, keys: list[str], data_range: float, hist_bins: int, halfwidth: float) -> DataFrame:
    """Synthetic (value) against real noisy images: quality and residual statistics differences."""
    rs, rr = dbl("value") - dbl("clean"), dbl("noisy") - dbl("clean")
    d = dbl("value") - dbl("noisy")
    g = pred.groupBy(*keys).agg(
        F.avg(d * d).alias("mse"), ssim_global_agg("value", "noisy", data_range).alias("ssim"),
        F.abs(F.avg(rs) - F.avg(rr)).alias("mean_error"), F.abs(F.stddev_pop(rs) - F.stddev_pop(rr)).alias("std_error"),
        F.abs(F.avg(F.abs(rs)) - F.avg(F.abs(rr))).alias("mae_error")).withColumn("psnr", psnr_from_mse("mse", data_range)).drop("mse")
    r = pred.select(*keys, (F.col("noisy") - F.col("clean")).alias("_a"), (F.col("value") - F.col("clean")).alias("_b"))
    return g.join(histogram_l1(r, keys, "_a", "_b", hist_bins, halfwidth), keys)


def residual_shape(df: DataFrame, keys: list[str], tail: float) -> DataFrame:
    """Shape of the residual: skew, kurtosis, quantiles, tails, signal correlation, row/column share."""
    d = df.withColumn("r", F.col("noisy") - F.col("clean"))
    probs = [0.001, 0.01, 0.5, 0.99, 0.999]
    names = ["q001", "q01", "q50", "q99", "q999"]
    g = d.groupBy(*keys).agg(
        F.avg("r").alias("residual_mean"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("residual_std"), F.var_pop("r").alias("_v"),
        F.skewness("r").alias("_sk"), F.kurtosis("r").alias("_ku"), F.count(F.lit(1)).alias("_n"),
        F.percentile("r", F.array(*[F.lit(p) for p in probs])).alias("_q"),
        corr_agg("clean", "r").alias("signal_correlation"), F.avg("clean").alias("_c"))
    # z uses the sample std: rescale the population moments
    shrink = F.sqrt((F.col("_n") - 1) / F.col("_n"))
    g = g.select(
        "*", (F.col("_sk") * shrink ** 3).alias("skewness"), ((F.col("_ku") + 3) * shrink ** 4 - 3).alias("excess_kurtosis"),
        *[F.element_at("_q", i + 1).alias(n) for i, n in enumerate(names)],
        (F.col("_v") / F.greatest("_c", F.lit(1e-12))).alias("fano_like"))
    z = F.abs((F.col("r") - F.col("residual_mean")) / F.greatest("residual_std", F.lit(1e-12)))
    t = d.join(g.select(*keys, "residual_mean", "residual_std"), keys).groupBy(*keys).agg(F.avg((z > tail).cast("double")).alias("tail_share"))
    def share(axis: str, name: str) -> DataFrame:
        return d.groupBy(*keys, axis).agg(F.avg("r").alias("_p")).groupBy(*keys).agg(F.var_pop("_p").alias(name))
    out = g.join(t, keys).join(share("y", "_row"), keys).join(share("x", "_col"), keys)
    return out.withColumn("row_share", F.col("_row") / F.greatest("_v", F.lit(1e-12))).withColumn(
        "column_share", F.col("_col") / F.greatest("_v", F.lit(1e-12))).drop("_v", "_sk", "_ku", "_n", "_q", "_c", "_row", "_col")


def variant_summary(df: DataFrame, variant: str, fields: list[str]) -> DataFrame:
    """mean/std/min/max of every field per variant, in one aggregation."""
    stats = ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max"))
    return df.groupBy(variant).agg(F.count(F.lit(1)).alias("rows"), *[f(dbl(c)).alias(f"{c}_{n}") for c in fields for f, n in stats])


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(0.5 * (F.abs(a) + F.abs(b)), F.lit(1e-12))


def curve_distances(curves: DataFrame, on: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(pair, cosine, l1, rmse, valid_fraction) of named pairs of variants' curves, on the places where both have a value.

    ``curves`` are (variant, on, value) rows; a null or NaN value, or a missing row, is invalid.
    ``valid_fraction`` relates the common places to all places of either curve; without a common
    place all distances are null.
    """
    side = F.array(*[F.struct(F.lit(name).alias("pair"), F.lit(v).alias("variant"), F.lit(first).alias("first")) for name, two in pairs.items() for v, first in ((two[0], True), (two[1], False))])
    value = F.when(~F.isnan("value"), F.col("value"))
    rows = curves.withColumn("_s", F.explode(F.filter(side, lambda s: s["variant"] == F.col("variant"))))
    at = rows.groupBy("_s.pair", *on).agg(F.max(F.when(F.col("_s.first"), value)).alias("a"), F.max(F.when(~F.col("_s.first"), value)).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    x, y = F.when(both, F.col("a")), F.when(both, F.col("b"))
    g = at.groupBy("pair").agg(
        F.sum(x * y).alias("_xy"), F.sqrt(F.sum(x * x)).alias("_x"), F.sqrt(F.sum(y * y)).alias("_y"), F.avg(F.abs(x - y)).alias("l1"),
        F.sqrt(F.avg((x - y) * (x - y))).alias("rmse"), F.avg(both.cast("double")).alias("valid_fraction"))
    return g.select("pair", (F.col("_xy") / F.greatest(F.col("_x") * F.col("_y"), F.lit(1e-12))).alias("cosine"), "l1", "rmse", "valid_fraction")


def decoupling_checks(summary: DataFrame, psd: DataFrame, autocorr: DataFrame, variants: list[str], limits: dict[str, float]) -> DataFrame:
    """Twelve named checks between the four variants (two structures x low and high strength) and an overall GO / STOP.

    ``summary`` has one row per variant: std (mean over pairs), target_error (largest relative
    error of a pair's std), mean_low and mean_high (of the pairs' residual means), clip (largest
    share of pixels out of range), signal_correlation, skew, kurtosis, tail (means over pairs).
    ``psd`` is (variant, radius, value), ``autocorr`` (variant, dy, dx, value), both normalised.
    Within a structure strength may only scale: spectra and autocorrelations must agree. Between
    structures at one strength something must differ. A check that cannot be decided fails.
    """
    fields = ["std", "target_error", "mean_low", "mean_high", "clip", "signal_correlation", "skew", "kurtosis", "tail"]
    pl, ph, hl, hh = variants
    wide = summary.agg(*[F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{v}:{c}") for v in variants for c in fields])
    same, other = {"first": (pl, ph), "second": (hl, hh)}, {"low": (pl, hl), "high": (ph, hh)}

    def spread(d: DataFrame, prefix: str, names: dict, columns: list[str]) -> DataFrame:
        return d.agg(*[F.max(F.when(F.col("pair") == n, F.col(c))).alias(f"{prefix}:{n}:{c}") for n in names for c in columns])

    spectra = spread(curve_distances(psd, ["radius"], {**same, **other}), "psd", {**same, **other}, ["cosine", "l1"])
    lags = spread(curve_distances(autocorr, ["dy", "dx"], same), "acf", same, ["rmse"])
    one = F.lit(1).alias("_k")
    w = wide.select("*", one).join(F.broadcast(spectra.select("*", one)), "_k").join(F.broadcast(lags.select("*", one)), "_k")  # one row each
    c = lambda v, k: F.col(f"`{v}:{k}`")

    def all_within(fields_: tuple[str, ...], limit: float) -> Column:
        ok = F.lit(True)
        for v in variants:
            for k in fields_:
                ok = ok & (F.abs(c(v, k)) <= limit)
        return ok

    checks = {
        "low_strength_matched": relative_difference(c(pl, "std"), c(hl, "std")) <= limits["std"],
        "high_strength_matched": relative_difference(c(ph, "std"), c(hh, "std")) <= limits["std"],
        "low_below_high": c(pl, "std") < c(ph, "std"),
        "target_std_realized": all_within(("target_error",), limits["std"]),
        "residual_mean_controlled": all_within(("mean_low", "mean_high"), limits["mean"]),
        "clipping_controlled": all_within(("clip",), limits["clip"]),
    }
    for n in same:
        checks[f"{n}_scale_only_psd"] = F.col(f"`psd:{n}:cosine`") >= limits["psd_cosine"]
        checks[f"{n}_scale_only_autocorr"] = F.col(f"`acf:{n}:rmse`") <= limits["autocorr_rmse"]
    for n, (a, b) in other.items():
        apart = lambda k, a=a, b=b: F.coalesce(F.abs(c(a, k) - c(b, k)) >= limits[k], F.lit(False))
        differs = F.coalesce(F.col(f"`psd:{n}:l1`") >= limits["psd_l1"], F.lit(False))
        for k in ("signal_correlation", "skew", "kurtosis", "tail"):
            differs = differs | apart(k)
        checks[f"{n}_structure_distinct"] = differs
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])
    return w.select(rows.alias("_c")).select(F.when(F.forall("_c", lambda r: r["passed"]), "GO").otherwise("STOP").alias("decision"), F.explode("_c").alias("_r")).select(
        "_r.check", "_r.passed", "decision")


def pair_moment_gate(df: DataFrame, keys: list[str], sigma: str, range_max: int, limits: dict[str, float]) -> DataFrame:
    """Residual moments, added clipping, mean z-score and the reasons a pair fails.

    Zeros and full-scale pixels count as far as the clean image does not have them already. Round-trip
    errors are those of rounding the noisy values to integers. Without a z limit the brightness shift decides.
    """
    r = F.col("noisy") - F.col("clean")
    rounded = F.least(F.greatest(F.rint("noisy"), F.lit(0)), F.lit(range_max))
    added = lambda noisy, clean: F.greatest(F.avg(noisy.cast("double")) - F.avg(clean.cast("double")), F.lit(0.0))
    hard = F.least(F.greatest(F.col("noisy"), F.lit(0)), F.lit(range_max))
    g = df.groupBy(*keys, sigma).agg(
        F.count(F.lit(1)).alias("pixels"), F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"),
        F.skewness(r).alias("skewness"), F.kurtosis(r).alias("excess_kurtosis"),
        F.avg((F.col("noisy") <= 0).cast("double")).alias("zero_ratio"), F.avg((F.col("noisy") >= range_max).cast("double")).alias("one_ratio"),
        added(F.col("noisy") <= 0, F.col("clean") <= 0).alias("added_zero_ratio"), added(F.col("noisy") >= range_max, F.col("clean") >= range_max).alias("added_one_ratio"),
        F.max(F.abs(rounded - hard)).cast("double").alias("noisy_round_trip"), F.max(F.abs((rounded - F.col("clean")) - (hard - F.col("clean")))).cast("double").alias("residual_round_trip"),
        (F.avg(hard) - F.avg("clean")).alias("brightness_shift"))
    g = g.withColumn("std_relative_error", safe_div(F.abs(F.col("residual_std") - F.col(sigma)), F.col(sigma))).withColumn(
        "z_mean", safe_div(F.col("residual_mean") * F.sqrt(dbl("pixels")), F.col(sigma))).withColumn(
        "clipping_contribution", F.col("brightness_shift") - F.col("residual_mean"))
    finite = F.lit(True)
    for c in ("residual_mean", "residual_std", "skewness", "excess_kurtosis", "brightness_shift", "std_relative_error", "z_mean"):
        finite = finite & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    by_z = "z_mean" in limits
    reasons = flag_list(
        ("NONFINITE", ~finite),
        ("SIGMA_ERROR", F.col("std_relative_error") >= limits["std_relative_error"]),
        ("RESIDUAL_MEAN_Z", F.abs("z_mean") > limits["z_mean"] if by_z else F.lit(False)),
        ("RESIDUAL_MEAN_SAFETY", F.abs("residual_mean") >= limits["residual_mean"] if by_z else F.lit(False)),
        ("BRIGHTNESS", F.lit(False) if by_z else F.abs("brightness_shift") >= limits["brightness_shift"]),
        ("ZERO_CLIPPING", F.col("added_zero_ratio") >= limits["zero_ratio"]),
        ("ONE_CLIPPING", F.col("added_one_ratio") >= limits["one_ratio"]),
        ("NOISY_ROUND_TRIP", F.col("noisy_round_trip") > limits.get("round_trip", 0.5)),
        ("RESIDUAL_ROUND_TRIP", F.col("residual_round_trip") > limits.get("round_trip", 0.5)))
    return g.withColumn("fail_reasons", reasons).withColumn("passed", F.col("fail_reasons") == "")


def frame_shift(raw_out: DataFrame) -> DataFrame:
    """(strategy, folder, frame): input and output frame mean and their difference."""
    return raw_out.groupBy("strategy", "folder", "frame").agg(
        F.avg("raw").alias("in_mean"), F.avg("value").alias("out_mean")).withColumn("shift", F.col("out_mean") - F.col("in_mean"))


def brightness_shift(raw_out: DataFrame, warn: float = 5.0, severe: float = 15.0) -> DataFrame:
    """Frame brightness change per (strategy, folder)."""
    key = ["strategy", "folder"]
    s = frame_shift(raw_out).withColumn("_abs", F.abs("shift"))
    q = exact_quantiles(s, key, "_abs", {"median_abs_shift": 0.5, "p95_abs_shift": 0.95})
    drift = lambda c: F.max_by(c, "frame") - F.min_by(c, "frame")
    return s.groupBy(*key).agg(
        F.avg("shift").alias("mean_shift"), F.max("_abs").alias("max_abs_shift"), drift("in_mean").alias("input_drift"),
        drift("out_mean").alias("output_drift"), F.sum((F.col("_abs") > warn).cast("bigint")).alias("warning_frames"),
        F.sum((F.col("_abs") > severe).cast("bigint")).alias("severe_frames")).join(q, key)


def dc_restore(raw_out: DataFrame, range_max: int) -> DataFrame:
    """Adds ``restored``: the output with the input's frame mean."""
    return raw_out.join(frame_shift(raw_out).select("strategy", "folder", "frame", "shift"), ["strategy", "folder", "frame"]).withColumn(
        "restored", F.col("value") - F.col("shift"))


def dc_restore_summary(raw_out: DataFrame, range_max: int) -> DataFrame:
    r = dc_restore(raw_out, range_max)
    return r.groupBy("strategy", "folder").agg(
        F.avg(F.col("value") - F.col("raw")).alias("shift_before"), F.avg(F.col("restored") - F.col("raw")).alias("shift_after"),
        F.avg((F.col("restored") < 0).cast("double")).alias("below_zero"), F.avg((F.col("restored") > range_max).cast("double")).alias("over_range"))


def removed_residual(raw_out: DataFrame, warn: float) -> DataFrame:
    """What an output removed: moments, row/column energy, tie to image structure."""
    key = ["strategy", "folder"]
    d = raw_out.withColumn("removed", F.col("raw") - F.col("value"))
    g = d.groupBy(*key).agg(F.avg("removed").alias("removed_mean"), F.stddev_samp("removed").alias("removed_std"))
    maps = d.groupBy(*key, "y", "x").agg(F.avg("raw").alias("m"), F.avg("removed").alias("r"), F.avg(F.abs("removed")).alias("a"))
    maps = sobel(maps, key, "m")
    c = maps.groupBy(*key).agg(corr_agg("a", "sobel").alias("gradient_correlation"), corr_agg("r", "m").alias("mean_correlation"))
    m = d.groupBy(*key, "y", "x").agg(F.avg("removed").alias("_t"))
    e = d.join(m, [*key, "y", "x"]).withColumn("r", F.col("removed") - F.col("_t"))
    fm = e.groupBy(*key, "frame").agg(F.avg("r").alias("_f"))
    e = e.join(fm, [*key, "frame"]).withColumn("r", F.col("r") - F.col("_f"))
    def energy(axis: str, name: str) -> DataFrame:
        p = e.groupBy(*key, "frame", axis).agg(F.avg("r").alias("p"))
        return p.groupBy(*key).agg(F.sqrt(F.avg(F.col("p") * F.col("p"))).alias(name))
    out = g.join(c, key).join(energy("y", "row_energy"), key).join(energy("x", "column_energy"), key)
    flag = (F.abs("gradient_correlation") > warn) | (F.abs("mean_correlation") > warn)
    return out.withColumn("structure_warning", F.coalesce(flag, F.lit(False)))


def proxy_quality(pixels: DataFrame, data_range: float) -> DataFrame:
    """Mean PSNR and windowed SSIM of every frame to the temporal mean and median maps."""
    maps = pixels.groupBy("folder", "y", "x").agg(F.avg("dn").alias("m"), F.percentile("dn", 0.5).alias("md"))
    j = pixels.join(maps, ["folder", "y", "x"])
    key = ["folder", "frame"]
    out = None
    for col, name in (("m", "mean"), ("md", "median")):
        d = dbl("dn") - F.col(col)
        q = j.groupBy(*key).agg(F.avg(d * d).alias("_mse")).select(*key, psnr_from_mse("_mse", data_range).alias("p"))
        s = ssim_windowed(j, key, "dn", col, data_range)
        per = q.join(s, key).groupBy("folder").agg(F.avg("p").alias(f"psnr_{name}"), F.avg("ssim").alias(f"ssim_{name}"))
        out = per if out is None else out.join(per, "folder")
    return out


__all__ = [n for n in dir() if not n.startswith("_")]
