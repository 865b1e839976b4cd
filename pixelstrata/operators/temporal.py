"""Statistics over the frames of a folder: maps, traces, drift, lags, references.

Everything is a partial aggregation on (folder, y, x) or (folder, frame). Maps are
joined back to pixels without a hint: adaptive execution broadcasts a small map
and splits skewed partitions of a large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelstrata.functions.ordering import add_bounded_quantiles, bounded_quantiles, exact_quantiles, with_halo
from pixelstrata.functions.scalars import clip, corr_agg, dbl, ratio, safe_div
from pixelstrata.operators.frames import explode_tiles
from pixelstrata.operators.spatial import gaussian_highpass
from pixelstrata.operators.spectral import band_fractions, power_blocks, power_spectrum
from pixelstrata.sources.storage import cut_lineage
from pixelstrata.operators.tiles import (
    PAIR_SUMS, PLACE, corr_of_sums, crop_summaries, frame_shape, lagged_tiles, map_pair_sums, neighbour_sums, pair_sums, pair_sums_by_label,
    profile_energy, tile_moments, tile_residual)

PIXEL = ["folder", "y", "x"]
FRAME = ["folder", "frame"]


def temporal_maps(pixels: DataFrame, value: str = "dn", median: bool = False) -> DataFrame:
    """Per-pixel count, mean, variance and std (ddof 0 and 1), range over frames."""
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
        F.var_pop(value).alias("var0"), F.var_samp(value).alias("var1"),
        F.stddev_pop(value).alias("std0"), F.stddev_samp(value).alias("std1"),
        F.min(value).alias("lo"), F.max(value).alias("hi"),
    ]
    if median:  # 16-bit values: at most 65,536 distinct per pixel
        aggs.append(F.percentile(value, 0.5).alias("median"))
    return pixels.groupBy(*PIXEL).agg(*aggs)


def frame_stats(pixels: DataFrame, value: str = "dn") -> DataFrame:
    """Per-frame mean, std, variance."""
    return pixels.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"), F.var_pop(value).alias("var"),
    )


def frame_summary(pixels: DataFrame, range_max: int) -> DataFrame:
    """Per-frame range, moments, percentiles, zero and saturated share."""
    probs = [0.001, 0.01, 0.5, 0.99, 0.999]
    return pixels.groupBy(*FRAME).agg(
        F.min("dn").alias("min"), F.max("dn").alias("max"), F.avg("dn").alias("mean"),
        F.stddev_pop("dn").alias("std"),
        F.percentile("dn", F.array(*[F.lit(p) for p in probs])).alias("_p"),
        F.avg((F.col("dn") == 0).cast("double")).alias("zero_ratio"),
        F.avg((F.col("dn") >= range_max).cast("double")).alias("saturation_ratio"),
    ).select("*", *[F.element_at("_p", i + 1).alias(n) for i, n in enumerate(["p0_1", "p1", "p50", "p99", "p99_9"])]).drop("_p")


def temporal_residual(pixels: DataFrame, demean: bool = True, value: str = "dn") -> DataFrame:
    """value minus the temporal mean map, then (optionally) minus the frame mean."""
    maps = pixels.groupBy(*PIXEL).agg(F.avg(value).alias("_m"))
    r = pixels.join(maps, PIXEL).withColumn("r", dbl(value) - F.col("_m")).drop("_m")
    if demean:
        r = r.withColumn("r", F.col("r") - F.avg("r").over(W.partitionBy(*FRAME)))
    return r


def folder_noise_summary(pixels: DataFrame, ddof: int = 1) -> DataFrame:
    """Signal, temporal noise, fixed pattern and their ratios per folder."""
    maps = temporal_maps(pixels)
    std, var = F.col(f"std{ddof}"), F.col(f"var{ddof}")
    spread = F.stddev_samp if ddof else F.stddev_pop
    maps = add_bounded_quantiles(maps.withColumn("_t", std), "folder", "_t", {"temporal_std_p50": 0.5, "temporal_std_p99": 0.99})
    by_folder = maps.groupBy("folder", "temporal_std_p50", "temporal_std_p99").agg(
        F.max("n").alias("frame_count"), F.avg("mean").alias("mean_signal"),
        F.coalesce(spread("mean"), F.lit(0.0)).alias("fixed_std"),
        F.avg(std).alias("temporal_std_mean"), F.avg(var).alias("temporal_var_mean"),
    )
    frames = frame_stats(pixels).groupBy("folder").agg(
        F.avg("mean").alias("frame_mean_mean"), F.coalesce(spread("mean"), F.lit(0.0)).alias("frame_mean_std"),
        F.min("mean").alias("frame_mean_min"), F.max("mean").alias("frame_mean_max"),
    )
    res = exact_quantiles(
        temporal_residual(pixels, demean=False), "folder", "r",
        {"residual_p01": 0.01, "residual_p50": 0.5, "residual_p99": 0.99},
    )
    return (
        by_folder.join(frames, "folder").join(res, "folder")
        .withColumn("fano_temporal", safe_div("temporal_var_mean", "mean_signal"))
        .withColumn("cv_temporal", safe_div("temporal_std_mean", "mean_signal"))
        .withColumn("fixed_to_temporal", safe_div("fixed_std", "temporal_std_mean"))
    )


def temporal_quantile_summary(pixels: DataFrame, range_max: int) -> DataFrame:
    """Quantiles and IQR of the temporal std map, zero and saturation share."""
    maps = temporal_maps(pixels)
    q = bounded_quantiles(maps, "folder", "std1", {
        "p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99})
    share = pixels.groupBy("folder").agg(
        F.avg((F.col("dn") == 0).cast("double")).alias("zero_ratio"),
        F.avg((F.col("dn") >= range_max).cast("double")).alias("saturation_ratio"),
    )
    return q.withColumn("iqr", F.col("p75") - F.col("p25")).join(share, "folder")


def robustness_grid(tiles: DataFrame, h: int, w: int, crops: list[int], counts: list[int | None]) -> DataFrame:
    """Noise summary for every centred crop and leading frame count (None = all), from one scan of the tiles."""
    size = {c: min(c, h, w) for c in crops}
    g = crop_summaries(tiles, {c: ((h - n) // 2, (w - n) // 2, n) for c, n in size.items()}, counts)
    return g.withColumn("fano_temporal", safe_div("temporal_var_mean", "mean_signal")).withColumn("fixed_to_temporal", safe_div("fixed_std", "temporal_std_mean"))


def robustness_delta(grid: DataFrame, reference: tuple[int, int], metrics: list[str]) -> DataFrame:
    """Absolute relative change of each metric against one reference cell."""
    ref = grid.where((F.col("crop") == reference[0]) & (F.col("frames") == reference[1])).select(
        "folder", *[F.col(m).alias(f"_{m}") for m in metrics])
    return grid.join(ref, "folder").select(
        "folder", "crop", "frames",
        *[F.abs(safe_div(F.col(m) - F.col(f"_{m}"), F.col(f"_{m}"))).alias(f"{m}_change") for m in metrics],
    )


def frame_differences(tiles: DataFrame, chunk: int = 1024) -> DataFrame:
    """Pixel rows (folder, frame, y, x, prev, d): each frame minus the one before.

    Lagging happens on compact tile rows in frame chunks with a one-frame halo.
    """
    t = with_halo(tiles, "frame", chunk, before=1)
    w = W.partitionBy("folder", "top", "left", "_chunk").orderBy("frame")
    t = t.withColumn("_prev", F.lag("dn", 1).over(w)).where(F.col("_core") & F.col("_prev").isNotNull())
    t = t.withColumn("dn", F.zip_with("dn", "_prev", lambda a, b: F.struct(a.alias("dn"), b.alias("prev")))).drop("_prev", "_chunk", "_core")
    p = explode_tiles(t)
    return p.select("folder", "frame", "y", "x", F.col("dn.dn").alias("dn"), F.col("dn.prev").alias("prev"),
                    (F.col("dn.dn") - F.col("dn.prev")).alias("d"))


def difference_variance_map(tiles: DataFrame, overlapping: bool = True) -> DataFrame:
    """Half the sample variance of frame differences per pixel."""
    d = frame_differences(tiles)
    if not overlapping:
        d = d.where(F.col("frame") % 2 == 0)
    return d.groupBy(*PIXEL).agg((F.var_samp("d") / 2).alias("diff_var"), F.count(F.lit(1)).alias("n_diff"))


def frame_difference_variance(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Difference-based against direct temporal variance, per folder."""
    m = temporal_maps(pixels).join(difference_variance_map(tiles), PIXEL)
    m = m.join(difference_variance_map(tiles, False).select(*PIXEL, F.col("diff_var").alias("diff_var_disjoint")), PIXEL)
    return m.groupBy("folder").agg(
        F.avg("var1").alias("direct_var"), F.avg("diff_var").alias("difference_var"),
        F.avg("diff_var_disjoint").alias("disjoint_var"), corr_agg("var1", "diff_var").alias("map_correlation"),
    ).withColumn("relative_difference", safe_div(F.col("difference_var") - F.col("direct_var"), F.col("direct_var")))


def equal_width_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin number in [0, bins), last bin closed; NULL outside [lo, hi]."""
    pos = F.floor(F.try_divide((v - lo) * bins, hi - lo))
    return F.when((v >= lo) & (v <= hi), F.least(F.coalesce(pos, F.lit(0)), F.lit(bins - 1))).cast("bigint")


def mean_variance_bins(pixels: DataFrame, tiles: DataFrame, bins: int, min_count: int,
                       lower: float = 0.005, upper: float = 0.995) -> DataFrame:
    """Temporal variance by equal-width bins of the temporal mean."""
    maps = temporal_maps(pixels).join(difference_variance_map(tiles), PIXEL)
    binned = add_bounded_quantiles(maps, "folder", "mean", {"bin_lo": lower, "bin_hi": upper}).withColumn(
        "bin", equal_width_bin(F.col("mean"), F.col("bin_lo"), F.col("bin_hi"), bins)).where(F.col("bin").isNotNull())
    binned = add_bounded_quantiles(binned, ["folder", "bin"], "var1", {"temporal_var_median": 0.5})
    total = pixels.groupBy("folder").agg(F.var_samp("dn").alias("global_total_pixel_var"))
    return (
        binned.groupBy("folder", "bin", "temporal_var_median").agg(
            F.count(F.lit(1)).alias("pixel_count"), F.avg("mean").alias("mean_signal"),
            F.avg("var1").alias("temporal_var_mean"), F.avg(F.sqrt("var1")).alias("temporal_std_mean"),
            F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("spatial_mean_std"),
            F.avg("diff_var").alias("frame_diff_var_mean"),
        ).where(F.col("pixel_count") >= min_count)
        .join(total, "folder")
        .withColumn("fano_temporal", safe_div("temporal_var_mean", "mean_signal"))
    )


def linear_regime_fit(bins: DataFrame, min_bins: int = 3) -> DataFrame:
    """Best low-signal prefix of bins with a positive slope, by R2."""
    w = W.partitionBy("folder").orderBy("mean_signal").rowsBetween(W.unboundedPreceding, 0)
    x, y = F.col("mean_signal"), F.col("temporal_var_mean")
    fits = bins.select(
        "folder", F.count(F.lit(1)).over(w).alias("linear_bin_count"), F.regr_slope(y, x).over(w).alias("slope"),
        F.regr_intercept(y, x).over(w).alias("intercept"), F.regr_r2(y, x).over(w).alias("r2"),
    ).where((F.col("linear_bin_count") >= max(3, min_bins)) & (F.col("slope") > 0))
    best = W.partitionBy("folder").orderBy(F.col("r2").desc(), "linear_bin_count")
    return fits.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k").withColumn(
        "inverse_slope", ratio(F.lit(1.0), "slope"))


def fixed_pattern_map(pixels: DataFrame, value: str = "dn") -> DataFrame:
    """Per-pixel mean minus its spatial mean."""
    m = pixels.groupBy(*PIXEL).agg(F.avg(value).alias("mean"))
    total = m.groupBy("folder").agg(F.avg("mean").alias("_s"))
    return m.join(total, "folder").select(*PIXEL, (F.col("mean") - F.col("_s")).alias("fixed"))


def fixed_pattern_eval(pixels: DataFrame) -> DataFrame:
    """Estimate the additive map on the first half of frames, correct the second half."""
    half = pixels.groupBy("folder").agg(F.floor(F.max("frame") / 2).alias("_half"))
    p = pixels.join(half, "folder").withColumn("train", F.col("frame") <= F.col("_half")).drop("_half")
    fixed = fixed_pattern_map(p.where("train"))
    test = p.where(~F.col("train")).join(fixed, PIXEL).withColumn("fixed_dn", dbl("dn") - F.col("fixed"))
    maps = test.groupBy(*PIXEL).agg(
        F.avg("dn").alias("mb"), F.avg("fixed_dn").alias("ma"), F.stddev_samp("dn").alias("tb"),
        F.stddev_samp("fixed_dn").alias("ta"), F.count(F.lit(1)).alias("n"), F.first("fixed").alias("fixed"))
    per = maps.groupBy("folder").agg(
        F.max("n").alias("test_frames"), F.avg("mb").alias("mean_before"), F.avg("ma").alias("mean_after"),
        F.stddev_samp("mb").alias("spatial_std_before"), F.stddev_samp("ma").alias("spatial_std_after"),
        F.avg("tb").alias("temporal_std_before"), F.avg("ta").alias("temporal_std_after"),
        F.stddev_samp("fixed").alias("fixed_map_std"), F.avg(F.col("ma") - F.col("mb")).alias("bias"),
    )
    reduction = safe_div(F.col("spatial_std_before") - F.col("spatial_std_after"), F.col("spatial_std_before"))
    change = safe_div(F.col("temporal_std_after") - F.col("temporal_std_before"), F.col("temporal_std_before"))
    return per.withColumn("spatial_reduction", reduction).withColumn("temporal_change", change).withColumn(
        "passes_spatial", F.coalesce(reduction >= 0.5, F.lit(False))).withColumn(
        "passes_temporal", F.coalesce(change <= 0.1, F.lit(False)))


def add_mad_limit(maps: DataFrame, value: str, k: float, name: str) -> DataFrame:
    """Adds median + k * max(1.4826 * MAD, 1) of a map, per folder."""
    d = add_bounded_quantiles(maps, "folder", value, {"_med": 0.5}).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    d = add_bounded_quantiles(d, "folder", "_dev", {"_mad": 0.5})
    return d.withColumn(name, F.col("_med") + k * F.greatest(1.4826 * F.col("_mad"), F.lit(1.0))).drop("_med", "_dev", "_mad")


def bad_pixel_mask(pixels: DataFrame, range_max: int, k: float) -> DataFrame:
    """Saturated or dead in any frame, or mean/std far above the folder median."""
    maps = temporal_maps(pixels)
    return add_mad_limit(add_mad_limit(maps, "mean", k, "_lm"), "std0", k, "_ls").select(
        *PIXEL,
        (F.col("hi") >= range_max).alias("saturated"), (F.col("lo") <= 0).alias("dead"),
        (F.col("mean") > F.col("_lm")).alias("hot"), (F.col("std0") > F.col("_ls")).alias("unstable"),
    ).withColumn("bad", F.col("saturated") | F.col("dead") | F.col("hot") | F.col("unstable"))


def background_audit(pixels: DataFrame, range_max: int) -> DataFrame:
    """Background folder statistics with hot and unstable pixel shares."""
    maps = temporal_maps(pixels)
    maps = add_bounded_quantiles(maps, "folder", "mean", {"hot_threshold": 0.999})
    maps = add_bounded_quantiles(maps, "folder", "std1", {"unstable_threshold": 0.999})
    per = maps.groupBy("folder", "hot_threshold", "unstable_threshold").agg(
        F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("spatial_std"), F.avg("std1").alias("temporal_std"),
        F.avg((F.col("mean") > F.col("hot_threshold")).cast("double")).alias("hot_fraction"),
        F.avg((F.col("std1") > F.col("unstable_threshold")).cast("double")).alias("unstable_fraction"),
    )
    fr = pixels.groupBy(*FRAME).agg(F.avg("dn").alias("m"), F.avg((F.col("dn") >= range_max).cast("double")).alias("s"))
    fr = fr.groupBy("folder").agg(
        F.avg("s").alias("saturation_mean"), F.max("s").alias("saturation_max"),
        (F.max("m") - F.min("m")).alias("frame_mean_range"))
    return per.join(fr, "folder")


def profiles(resid: DataFrame, axis: str, value: str = "r") -> DataFrame:
    """Mean residual of each row (axis='y') or column (axis='x') of each frame."""
    return resid.groupBy(*FRAME, axis).agg(F.avg(value).alias("p"))


def row_column_energy(resid: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(per folder, per frame block): RMS row and column energy and removed variance share."""
    rows, cols = profiles(resid, "y"), profiles(resid, "x")
    blk = F.floor((F.col("frame") - 1) / block).cast("bigint").alias("block")
    e = lambda df, n: df.groupBy("folder", blk).agg(
        F.sum(F.col("p") * F.col("p")).alias(f"_{n}s"), F.count(F.lit(1)).alias(f"_{n}n"),
        F.count_distinct("frame").alias(f"_{n}f"))
    b = e(rows, "r").join(e(cols, "c").drop("_cf"), ["folder", "block"])
    blocks = b.where(F.col("_rf") >= 2).select(
        "folder", "block", F.col("_rf").alias("frames"),
        F.sqrt(F.col("_rs") / F.col("_rn")).alias("row_energy"), F.sqrt(F.col("_cs") / F.col("_cn")).alias("column_energy"))
    total = b.groupBy("folder").agg(
        F.sqrt(F.sum("_rs") / F.sum("_rn")).alias("row_energy"), F.sqrt(F.sum("_cs") / F.sum("_cn")).alias("column_energy"))
    fixed = resid.join(rows.withColumnRenamed("p", "_rp"), [*FRAME, "y"]).join(cols.withColumnRenamed("p", "_cp"), [*FRAME, "x"])
    stds = fixed.groupBy("folder").agg(
        F.stddev_samp("r").alias("std_before"), F.stddev_samp(F.col("r") - F.col("_rp") - F.col("_cp")).alias("std_after"))
    cv = blocks.groupBy("folder").agg(
        safe_div(F.stddev_samp("row_energy"), F.avg("row_energy")).alias("row_block_cv"),
        safe_div(F.stddev_samp("column_energy"), F.avg("column_energy")).alias("column_block_cv"))
    summary = total.join(stds, "folder").join(cv, "folder", "left").withColumn(
        "variance_removed", 1 - safe_div(F.col("std_after") * F.col("std_after"), F.col("std_before") * F.col("std_before")))
    return summary, blocks


def lag_pairs(rows: DataFrame, keys: list[str], lags: list[int], value: str) -> DataFrame:
    """Rows (keys, frame, lag, a, b): value at frame and at frame + lag."""
    left = rows.select(*keys, "frame", dbl(value).alias("a")).withColumn(
        "lag", F.explode(F.array(*[F.lit(v).cast("bigint") for v in lags]))).withColumn("_to", F.col("frame") + F.col("lag"))
    right = rows.select(*keys, F.col("frame").alias("_to"), dbl(value).alias("b"))
    return left.join(right, [*keys, "_to"]).drop("_to")


def profile_adjacent_corr(resid: DataFrame) -> DataFrame:
    """Mean correlation of row and column profiles between neighbouring frames."""
    def one(axis: str, name: str) -> DataFrame:
        p = lag_pairs(profiles(resid, axis), ["folder", axis], [1], "p")
        return p.groupBy(*FRAME).agg(corr_agg("a", "b").alias("c")).groupBy("folder").agg(F.avg("c").alias(name))
    return one("y", "row_correlation").join(one("x", "column_correlation"), "folder")


def lag_correlation(resid: DataFrame, lags: list[int]) -> DataFrame:
    """Mean and largest absolute correlation between residual tiles of frames f and f + lag."""
    per = lagged_tiles(resid, ["folder"], "r", lags, pair_sums, PAIR_SUMS).groupBy(*FRAME, "lag").agg(corr_of_sums().alias("c"))
    return per.groupBy("folder", "lag").agg(
        F.count("c").alias("pairs"), F.avg("c").alias("correlation_mean"), F.max(F.abs("c")).alias("correlation_max_abs"))


def lag_correlation_by_brightness(tiles: DataFrame, resid: DataFrame, lags: list[int], bins: int) -> DataFrame:
    """Lag correlation inside quantile bins of the temporal mean."""
    maps = tile_moments(tiles, ["folder"])
    edges = exact_quantiles(maps.select("folder", F.explode("mean").alias("mean")), "folder", "mean", {f"_e{i}": i / bins for i in range(1, bins)})
    label = F.transform("mean", lambda m: sum(((m >= F.col(f"_e{i}")).cast("bigint") for i in range(1, bins)), F.lit(0).cast("bigint")))
    labels = maps.join(edges, "folder").select("folder", "top", "left", label.alias("_label"))
    per = lagged_tiles(resid.join(labels, ["folder", "top", "left"]), ["folder"], "r", lags, pair_sums_by_label, f"bin bigint, {PAIR_SUMS}", "_label")
    per = per.groupBy(*FRAME, "lag", "bin").agg(corr_of_sums().alias("c"))
    return per.groupBy("folder", "lag", "bin").agg(F.avg("c").alias("correlation_mean"), F.max(F.abs("c")).alias("correlation_max_abs"))


def bias_corrected_shape(n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    """Sample skewness and excess kurtosis from the population ones."""
    n = dbl(n)
    return (
        skew * F.sqrt(n * (n - 1)) / (n - 2),
        ((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * kurt + 6),
    )


def lag_difference_moments(tiles: DataFrame, lags: list[int]) -> DataFrame:
    """Moments of frame f + lag minus frame f, from power sums of whole tiles."""
    def powers(a, b) -> list[dict[str, float]]:
        d = b - a
        return [{"n": len(d), **{f"s{k}": float((d**k).sum()) for k in range(1, 5)}}]

    per = lagged_tiles(tiles, ["folder"], "dn", lags, powers, "n bigint, s1 double, s2 double, s3 double, s4 double")
    g = per.groupBy("folder", "lag").agg(F.sum("n").alias("n"), *[(F.sum(f"s{k}") / F.sum("n")).alias(f"_{k}") for k in range(1, 5)])
    m, m2, m3, m4 = (F.col(f"_{k}") for k in range(1, 5))
    var = m2 - m * m
    g = g.withColumn("std", F.sqrt(F.greatest(var, F.lit(0.0))))
    g = g.withColumn("_s", ratio(m3 - 3 * m * m2 + 2 * m * m * m, F.pow("std", 3))).withColumn("_k", ratio(m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * F.pow(m, 4), F.pow("std", 4)) - 3)
    s, k = bias_corrected_shape(F.col("n"), F.col("_s"), F.col("_k"))
    return g.where(F.col("n") > 3).select("folder", "lag", "n", m.alias("mean"), "std", s.alias("skewness"), k.alias("excess_kurtosis"))


def frame_trace(stats: DataFrame, window: int, chunk: int = 65536) -> DataFrame:
    """Frame series with trailing rolling means; long series are cut in overlapping chunks."""
    h = with_halo(stats, "frame", max(chunk, window), before=window - 1)
    w = W.partitionBy("folder", "_chunk").orderBy("frame").rowsBetween(-(window - 1), 0)
    return h.select(
        "*", F.avg("mean").over(w).alias("rolling_mean"), F.avg("var").over(w).alias("rolling_variance")
    ).where("_core").drop("_chunk", "_core")


def with_half(df: DataFrame) -> DataFrame:
    """Adds ``second``: the frame lies in the second half of its folder."""
    n = df.groupBy("folder").agg(F.max("frame").alias("_n"))
    return df.join(n, "folder").withColumn("second", F.col("frame") > F.floor(F.col("_n") / 2)).drop("_n")


def drift_summary(pixels: DataFrame, grid_h: int, grid_w: int) -> DataFrame:
    """Trend of the frame mean and std, half-to-half change, largest local change."""
    st = with_half(frame_stats(pixels))
    half = lambda c, s: F.avg(F.when(F.col("second") == s, F.col(c)))
    g = st.groupBy("folder").agg(
        F.regr_slope("mean", "frame").alias("mean_slope"), F.regr_slope("std", "frame").alias("std_slope"),
        half("mean", False).alias("first_half"), half("mean", True).alias("second_half"),
        (half("std", True) - half("std", False)).alias("std_delta"))
    g = g.withColumn("mean_delta", F.col("second_half") - F.col("first_half")).withColumn(
        "relative_change", safe_div("mean_delta", "first_half"))
    cell = with_half(pixels).groupBy(
        "folder", F.floor(F.col("y") / grid_h).alias("_gy"), F.floor(F.col("x") / grid_w).alias("_gx")).agg(
        half("dn", False).alias("a"), half("dn", True).alias("b"))
    local = cell.groupBy("folder").agg(F.max(F.abs(safe_div(F.col("b") - F.col("a"), F.col("a")))).alias("max_local_change"))
    return g.join(local, "folder").withColumn("drift_flag", F.abs("relative_change") > 0.01)


def subset_flags(names: list[str], block: int = 10) -> dict[str, Column]:
    """Membership tests of named frame subsets; needs ``frame`` and ``_n`` (frames in the folder)."""
    f, n = F.col("frame"), F.col("_n")
    half = F.floor(n / 2)
    tests = {
        "all": F.lit(True),
        "odd": f % 2 == 1,
        "even": f % 2 == 0,
        "first_half": f <= half,
        "second_half": f > half,
        "middle_half": (f > F.floor(n / 4)) & (f <= F.floor(n / 4) + half),
        "block_a": F.floor((f - 1) / block) % 2 == 0,
        "block_b": F.floor((f - 1) / block) % 2 == 1,
        # half of the frames, chosen by a hash so that every run picks the same ones
        "hashed_half": F.conv(F.substring(F.md5(F.concat_ws(":", F.col("folder").cast("string"), f.cast("string"))), 1, 4), 16, 10).cast("bigint") % 2 == 0,
    }
    return {k: tests[k] for k in names}


def frame_subsets(df: DataFrame, names: list[str], block: int = 10) -> DataFrame:
    """Every row once per named subset its frame belongs to."""
    n = df.groupBy("folder").agg(F.max("frame").alias("_n"))
    flags = subset_flags(names, block)
    arr = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in flags.items()]))
    return df.join(n, "folder").withColumn("subset", F.explode(arr)).drop("_n")


SPLITS = {"odd_even": ("odd", "even"), "halves": ("first_half", "second_half"), "blocks": ("block_a", "block_b")}


def split_map_repeatability(pixels: DataFrame, sigma: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(per split, per folder): agreement of high-passed maps from disjoint frame groups."""
    names = [s for pair in SPLITS.values() for s in pair]
    sub = frame_subsets(pixels, names, block)
    maps = sub.groupBy("folder", "subset", "y", "x").agg(F.avg("dn").alias("mean"))
    hp = gaussian_highpass(maps, ["folder", "subset"], "mean", sigma)
    first = F.create_map(*[F.lit(v) for s, (a, b) in SPLITS.items() for v in (a, s, b, s)])
    side = F.col("subset").isin([a for a, _ in SPLITS.values()])
    pairs = hp.withColumn("split", first[F.col("subset")]).groupBy("folder", "split", "y", "x").agg(
        F.max(F.when(side, F.col("hp"))).alias("a"), F.max(F.when(~side, F.col("hp"))).alias("b"))
    per = pairs.groupBy("folder", "split").agg(
        corr_agg("a", "b").alias("correlation"), F.stddev_samp((F.col("a") + F.col("b")) / 2).alias("stable_std"),
        F.stddev_samp((F.col("a") - F.col("b")) / F.sqrt(F.lit(2.0))).alias("difference_std"),
    ).withColumn("ratio", safe_div("stable_std", "difference_std"))
    med = lambda c: F.percentile(c, 0.5)  # noqa: E731  three splits per folder
    folder = per.groupBy("folder").agg(
        F.min("correlation").alias("min_correlation"), med("correlation").alias("median_correlation"),
        med("stable_std").alias("stable_std"), med("difference_std").alias("difference_std"))
    return per, folder.withColumn("ratio", safe_div("stable_std", "difference_std")).withColumn(
        "low_repeatability", F.col("min_correlation") < 0.5)


def frame_consistency(tiles: DataFrame) -> DataFrame:
    """Std and mean absolute value of adjacent differences, mean adjacent correlation."""
    d = frame_differences(tiles)
    base = d.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"),
        F.sum(F.abs("d")).alias("sa"), corr_agg("prev", "dn").alias("c"))
    n, s, ss = F.sum("n"), dbl(F.sum("s")), dbl(F.sum("ss"))
    return base.groupBy("folder").agg(
        F.sqrt(ss / n - (s / n) * (s / n)).alias("difference_std"), (dbl(F.sum("sa")) / n).alias("difference_mae"),
        F.avg("c").alias("adjacent_correlation"))


def subset_noise(tiles: DataFrame, names: list[str], edges: tuple[float, float, float], block: int = 10) -> DataFrame:
    """Noise of each frame subset from tile arrays, one row a folder and subset.

    temporal_std, mean_signal, row_energy, column_energy; acf1, the mean of the two axial and, twice, the diagonal lag-1
    correlation of the residuals; dc to high fraction of their windowed spectrum; map_correlation of the subset's map of
    temporal stds with that of subset ``all``, which must be among the names (else null). Undefined values are null.
    """
    key = ["folder", "subset"]
    shape = frame_shape(tiles)
    sub = frame_subsets(tiles, names, block)
    moments = tile_moments(sub, key).select(*key, *PLACE, "mean", F.transform("m2", lambda v: F.when(F.col("n") > 1, F.sqrt(v / (F.col("n") - 1)))).alias("s"))
    moments = cut_lineage(moments)
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda t, v: t + v))
    pixels = F.sum(F.size("s"))
    out = moments.groupBy(*key).agg((total("s") / pixels).alias("temporal_std"), (total("mean") / pixels).alias("mean_signal"))
    resid = cut_lineage(tile_residual(sub, keys=tuple(key), shape=shape))
    near = neighbour_sums(resid, key, "r", [(0, 1), (1, 0), (1, 1)], shape)
    corr = safe_div(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb")))
    acf = near.groupBy(*key).agg((F.sum(F.when(F.col("dy") * F.col("dx") == 1, 2.0).otherwise(1.0) * corr) / F.when(F.count(corr) == 3, 4.0)).alias("acf1"))
    bands = band_fractions(power_spectrum(power_blocks(resid, key, hann=True, shape=shape), key), key, edges)
    full = moments.where(F.col("subset") == "all").select("folder", *PLACE, F.col("s").alias("_s"))
    maps = map_pair_sums(moments.join(full, ["folder", *PLACE]), key, "s", "_s").groupBy(*key).agg(corr_of_sums().alias("map_correlation"))
    for part in (profile_energy(resid, key, "r", shape), acf, bands, maps):
        out = out.join(part, key, "left")
    return out


def frame_convergence(subsets: DataFrame, relative: list[str], absolute: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Error of each subset's metrics against all frames: relative (signed) or absolute; ``keep`` columns as they are."""
    full = subsets.where(F.col("subset") == "all").select("folder", *[F.col(m).alias(f"_{m}") for m in [*relative, *absolute]])
    return subsets.join(full, "folder").select(
        "folder", "subset", *[safe_div(F.col(m) - F.col(f"_{m}"), F.col(f"_{m}")).alias(f"{m}_error") for m in relative],
        *[F.abs(F.col(m) - F.col(f"_{m}")).alias(f"{m}_error") for m in absolute], *keep)


def frame_count_recommendation(grid: DataFrame, metrics: list[str], tolerance: float, required: float) -> DataFrame:
    """Smallest frame count whose folders meet the tolerance often enough, per metric."""
    full = grid.where(F.col("frames") == 0).select("folder", "crop", *[F.col(m).alias(f"_{m}") for m in metrics])
    rows = grid.join(full, ["folder", "crop"]).withColumn("_m", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.abs(safe_div(F.col(m) - F.col(f"_{m}"), F.col(f"_{m}"))).alias("err")) for m in metrics])))
    count = F.when(F.col("frames") == 0, F.lit(None).cast("bigint")).otherwise(F.col("frames"))
    frac = rows.groupBy(F.col("_m.metric").alias("metric"), "frames").agg(
        F.avg(F.coalesce((F.col("_m.err") <= tolerance).cast("double"), F.lit(0.0))).alias("share"))
    return frac.groupBy("metric").agg(
        F.min(F.when((F.col("share") >= required), count)).alias("recommended"),
        F.max("share").alias("best_share"),
    ).withColumn("recommended", F.coalesce("recommended", F.lit(0).cast("bigint")))


def target_candidates(pixels: DataFrame, schemes: dict[str, tuple[int, int]]) -> DataFrame:
    """Noise of input and target means of consecutive frame blocks against all other frames.

    The complement mean is (folder sum - block sum) / (rest), so nothing is re-read.
    """
    arr = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(a + b).alias("w")) for k, (a, b) in schemes.items()])
    counts = pixels.groupBy("folder").agg(F.max("frame").alias("_n"))
    e = pixels.join(counts, "folder").withColumn("_s", F.explode(arr)).withColumn(
        "block", F.floor((F.col("frame") - 1) / F.col("_s.w"))).where((F.col("block") + 1) * F.col("_s.w") <= F.col("_n"))
    is_input = (F.col("frame") - 1) % F.col("_s.w") < F.col("_s.a")
    b = e.groupBy("folder", "_n", F.col("_s.k").alias("scheme"), F.col("_s.a").alias("a"), F.col("_s.w").alias("w"), "block", "y", "x").agg(
        F.sum(F.when(is_input, F.col("dn")).otherwise(0)).alias("si"), F.sum("dn").alias("sb"))
    tot = pixels.groupBy(*PIXEL).agg(F.sum("dn").alias("st"))
    b = b.join(tot, PIXEL).select(
        "folder", "scheme", "block", (F.col("si") / F.col("a")).alias("i"),
        ((F.col("sb") - F.col("si")) / (F.col("w") - F.col("a"))).alias("t"),
        ((F.col("st") - F.col("sb")) / F.when(F.col("_n") > F.col("w"), F.col("_n") - F.col("w"))).alias("c"))
    per = b.groupBy("folder", "scheme", "block").agg(
        F.stddev_pop(F.col("i") - F.col("c")).alias("i"), F.stddev_pop(F.col("t") - F.col("c")).alias("t"),
        F.avg(F.col("t") - F.col("c")).alias("b"), F.stddev_pop(F.col("i") - F.col("t")).alias("d"))
    return per.groupBy("folder", "scheme").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("i").alias("input_std"), F.avg("t").alias("target_std"),
        F.avg("b").alias("target_bias"), F.avg("d").alias("difference_std"))


def temporal_reduction(raw_out: DataFrame) -> DataFrame:
    """1 - var(output) / var(raw) per (folder, strategy): plain, frame-mean-centred, after DC restoration.

    Input rows: (strategy, folder, frame, y, x, raw, value).
    """
    key = ["strategy", "folder"]
    fm = raw_out.groupBy(*key, "frame").agg(F.avg("raw").alias("_rm"), F.avg("value").alias("_vm"))
    p = raw_out.join(fm, [*key, "frame"])
    m = p.groupBy(*key, "y", "x").agg(
        F.var_pop("raw").alias("r"), F.var_pop("value").alias("v"),
        F.var_pop(F.col("raw") - F.col("_rm")).alias("rc"), F.var_pop(F.col("value") - F.col("_vm")).alias("vc"),
        F.var_pop(F.col("value") - F.col("_vm") + F.col("_rm")).alias("vr"))
    red = lambda a, b: 1 - safe_div(F.avg(a), F.avg(b))
    return m.groupBy(*key).agg(red("v", "r").alias("reduction"), red("vc", "rc").alias("centered_reduction"), red("vr", "r").alias("restored_reduction"))


def prefix_references(pixels: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Mean maps over overlapping frame ranges, given as fractions of the folder's frames."""
    n = pixels.groupBy("folder").agg(F.max("frame").alias("_n"))
    arr = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in ranges.items()])
    e = pixels.join(n, "folder").withColumn("_r", F.explode(arr)).where(
        (F.col("frame") > F.floor(F.col("_n") * F.col("_r.a"))) & (F.col("frame") <= F.floor(F.col("_n") * F.col("_r.b"))))
    return e.groupBy("folder", F.col("_r.k").alias("reference"), "y", "x").agg(
        F.count(F.lit(1)).alias("frames"), F.avg("dn").alias("mean"))


def registration_shift(tiles: DataFrame, group: int, upsample: int = 10, sigma: float = 1.0) -> DataFrame:
    """Sub-pixel shift of frame-group means against their common mean (phase correlation).

    Frequencies weigh as a Gaussian smoothing of both images leaves them, so pixel noise does not decide the peak.
    """
    import numpy as np
    import pandas as pd

    px = explode_tiles(tiles)
    g = F.floor((F.col("frame") - 1) / group).cast("bigint").alias("grp")
    means = px.groupBy("folder", g, "y", "x").agg(F.avg("dn").alias("m"))
    ref = means.groupBy(*PIXEL).agg(F.avg("m").alias("ref"))
    joined = means.join(ref, PIXEL)

    def shift(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        a = pdf.ref.to_numpy().reshape(h, w)
        b = pdf.m.to_numpy().reshape(h, w)
        cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
        cross /= np.maximum(np.abs(cross), 1e-12)
        cross *= np.exp(-4 * (np.pi * sigma) ** 2 * (np.fft.fftfreq(h)[:, None] ** 2 + np.fft.fftfreq(w)[None] ** 2))
        peak = np.unravel_index(np.argmax(np.abs(np.fft.ifft2(cross))), (h, w))
        whole = [p - n if p > n // 2 else p for p, n in zip(peak, (h, w))]
        # local DFT around the whole-pixel peak at 1/upsample steps
        steps = np.arange(-upsample, upsample + 1) / upsample
        fy, fx = np.fft.fftfreq(h), np.fft.fftfreq(w)
        ey = np.exp(2j * np.pi * np.outer(whole[0] + steps, fy))
        ex = np.exp(2j * np.pi * np.outer(fx, whole[1] + steps))
        best = np.unravel_index(np.argmax(np.abs(ey @ cross @ ex)), (steps.size, steps.size))
        dy, dx = whole[0] + steps[best[0]], whole[1] + steps[best[1]]
        return pd.DataFrame({"folder": [pdf.folder.iloc[0]], "grp": [pdf.grp.iloc[0]], "shift": [float(np.hypot(dy, dx))]})

    per = joined.groupBy("folder", "grp").applyInPandas(shift, "folder bigint, grp bigint, shift double")
    return per.groupBy("folder").agg(
        F.avg("shift").alias("shift_mean"), F.max("shift").alias("shift_max"), F.count(F.lit(1)).alias("groups"),
        F.percentile("shift", 0.95).alias("shift_p95"))  # shifts are multiples of 1/upsample: few distinct values


def condition_bins(value: Column, edges: list[Column]) -> Column:
    """Number of interior edges at or below the value."""
    return sum(((value >= e).cast("bigint") for e in edges), F.lit(0).cast("bigint"))


def unit(c, data_range: float) -> Column:
    return clip(dbl(c) / data_range, 0.0, 1.0)
