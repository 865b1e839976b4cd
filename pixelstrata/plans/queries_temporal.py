"""Frame, folder and temporal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelstrata.functions.scalars import big, flag_list, rnd
from pixelstrata.operators import temporal as T
from pixelstrata.operators.pairs import (
    image_quality, intensity_residual_bins, ssim_global_agg, surrogate_pairs,
)
from pixelstrata.operators.spatial import central_gradient
from pixelstrata.operators.tiles import frame_shape, tile_residual
from pixelstrata.plans.fourier_sql import BANDS_SQL, DFT, EDGES, FREQ, HANN
from pixelstrata.plans.registry import query
from pixelstrata.plans.views import RANGE, Tables

TOP = int(RANGE)


def sel(df, keys, digits=4, **named):
    """Keys as they are, statistics rounded; ``named`` overrides the digits of a column."""
    cols = list(keys)
    for c, t in df.dtypes:
        if c in keys:
            continue
        if t == "double":
            cols.append(rnd(c, named.get(c, digits)).alias(c))
        elif t in ("int", "bigint"):
            cols.append(big(c).alias(c))
        else:
            cols.append(c)
    return df.select(*cols)


@query("temporal_maps", """
    SELECT folder, y, x, n, R4(mean) AS mean, R2(var0) AS var0, R2(var1) AS var1, R4(std0) AS std0, R4(std1) AS std1,
           lo, hi, R4(med) AS median
    FROM fx_maps JOIN (SELECT folder, y, x, min(dn) AS lo, max(dn) AS hi FROM fx_frames GROUP BY ALL) USING (folder, y, x)""")
def _(t: Tables):
    return sel(T.temporal_maps(t.pixels_anywhere(), median=True), T.PIXEL, var0=2, var1=2)


@query("frame_summary", """
    SELECT folder, frame, min(dn) AS min, max(dn) AS max, R4(avg(dn)) AS mean, R4(stddev_pop(dn)) AS std,
      R4(quantile_cont(CAST(dn AS DOUBLE), 0.001)) AS p0_1, R4(quantile_cont(CAST(dn AS DOUBLE), 0.01)) AS p1,
      R4(quantile_cont(CAST(dn AS DOUBLE), 0.5)) AS p50, R4(quantile_cont(CAST(dn AS DOUBLE), 0.99)) AS p99,
      R4(quantile_cont(CAST(dn AS DOUBLE), 0.999)) AS p99_9,
      R4(avg(CASE WHEN dn = 0 THEN 1.0 ELSE 0.0 END)) AS zero_ratio,
      R4(avg(CASE WHEN dn >= 65535 THEN 1.0 ELSE 0.0 END)) AS saturation_ratio
    FROM fx_frames GROUP BY folder, frame""")
def _(t: Tables):
    return sel(T.frame_summary(t.pixels(), TOP), T.FRAME)


@query("collection_summary", """
    WITH s AS (SELECT folder, frame, min(dn) AS mn, max(dn) AS mx, avg(dn) AS m, stddev_pop(dn) AS sd FROM fx_frames GROUP BY ALL)
    SELECT folder, count(*) AS frames, R4(avg(m)) AS mean, R4(avg(sd)) AS std,
           min(mn) || '..' || max(mx) AS value_range FROM s GROUP BY folder""")
def _(t: Tables):
    s = T.frame_summary(t.pixels(), TOP)
    g = s.groupBy("folder").agg(
        F.count(F.lit(1)).alias("frames"), F.avg("mean").alias("mean"), F.avg("std").alias("std"),
        F.concat(F.min("min").cast("string"), F.lit(".."), F.max("max").cast("string")).alias("value_range"))
    return sel(g, ["folder"])


NOISE_SQL = """
    WITH m AS (SELECT folder, max(n) AS frame_count, avg(mean) AS mean_signal, {sd}(mean) AS fixed_std,
        avg(std{d}) AS ts, quantile_cont(std{d}, 0.5) AS p50, quantile_cont(std{d}, 0.99) AS p99, avg(var{d}) AS tv FROM fx_maps GROUP BY folder),
      f AS (SELECT folder, avg(mean) AS fm, {sd}(mean) AS fs, min(mean) AS fmin, max(mean) AS fmax FROM fx_fstat GROUP BY folder),
      r AS (SELECT folder, quantile_cont(r, 0.01) AS r1, quantile_cont(r, 0.5) AS r50, quantile_cont(r, 0.99) AS r99 FROM fx_resid GROUP BY folder)
    SELECT folder, frame_count, R4(mean_signal) AS mean_signal, R4(fixed_std) AS fixed_std, R4(ts) AS temporal_std_mean,
      R2(tv) AS temporal_var_mean, R4(fm) AS frame_mean_mean, R4(fs) AS frame_mean_std, R4(fmin) AS frame_mean_min,
      R4(fmax) AS frame_mean_max, R4(p50) AS temporal_std_p50, R4(p99) AS temporal_std_p99, R4(r1) AS residual_p01,
      R4(r50) AS residual_p50, R4(r99) AS residual_p99, R4(tv / mean_signal) AS fano_temporal,
      R6(ts / mean_signal) AS cv_temporal, R6(fixed_std / ts) AS fixed_to_temporal
    FROM m JOIN f USING (folder) JOIN r USING (folder)"""


@query("folder_noise_summary", NOISE_SQL.format(sd="stddev_samp", d=1))
def _(t: Tables):
    return sel(T.folder_noise_summary(t.pixels()), ["folder"], temporal_var_mean=2, cv_temporal=6, fixed_to_temporal=6)


@query("folder_noise_summary_ddof0", NOISE_SQL.format(sd="stddev_pop", d=0))
def _(t: Tables):
    return sel(T.folder_noise_summary(t.pixels(), ddof=0), ["folder"], temporal_var_mean=2, cv_temporal=6, fixed_to_temporal=6)


@query("temporal_quantile_summary", """
    SELECT folder, R4(quantile_cont(std1, 0.01)) AS p01, R4(quantile_cont(std1, 0.05)) AS p05, R4(quantile_cont(std1, 0.25)) AS p25,
      R4(quantile_cont(std1, 0.5)) AS p50, R4(quantile_cont(std1, 0.75)) AS p75, R4(quantile_cont(std1, 0.95)) AS p95,
      R4(quantile_cont(std1, 0.99)) AS p99, R4(quantile_cont(std1, 0.75) - quantile_cont(std1, 0.25)) AS iqr,
      R6(any_value(z)) AS zero_ratio, R6(any_value(s)) AS saturation_ratio
    FROM fx_maps JOIN (SELECT folder, avg(CASE WHEN dn = 0 THEN 1.0 ELSE 0.0 END) AS z,
      avg(CASE WHEN dn >= 65535 THEN 1.0 ELSE 0.0 END) AS s FROM fx_frames GROUP BY folder) USING (folder) GROUP BY folder""")
def _(t: Tables):
    return sel(T.temporal_quantile_summary(t.pixels_anywhere(), TOP), ["folder"])


CROPS, COUNTS = [4, 8], [16, 32, None]
GRID_CTE = """
    g AS (SELECT folder, c.crop, k.frames, frame, y, x, dn FROM fx_frames, (VALUES (4, 2, 4), (8, 0, 8)) c(crop, o, s),
            (VALUES (16), (32), (0)) k(frames)
          WHERE y >= o AND y < o + s AND x >= o AND x < o + s AND (k.frames = 0 OR frame <= k.frames)),
    gm AS (SELECT folder, crop, frames, max(n) AS frame_count, avg(mean) AS mean_signal, stddev_samp(mean) AS fixed_std,
             avg(sd) AS temporal_std_mean, avg(v) AS temporal_var_mean
           FROM (SELECT folder, crop, frames, y, x, count(*) AS n, avg(dn) AS mean, stddev_samp(dn) AS sd, var_samp(dn) AS v FROM g GROUP BY ALL)
           GROUP BY ALL),
    gf AS (SELECT folder, crop, frames, stddev_samp(m) AS frame_mean_std
           FROM (SELECT folder, crop, frames, frame, avg(dn) AS m FROM g GROUP BY ALL) GROUP BY ALL),
    grid AS (SELECT *, temporal_var_mean / mean_signal AS fano_temporal, fixed_std / temporal_std_mean AS fixed_to_temporal
             FROM gm JOIN gf USING (folder, crop, frames))"""


def grid(t: Tables):
    return T.robustness_grid(t.tiles(), 8, 8, CROPS, COUNTS)


@query("robustness_grid", f"""WITH {GRID_CTE}
    SELECT folder, CAST(crop AS BIGINT) AS crop, CAST(frames AS BIGINT) AS frames, frame_count, R4(mean_signal) AS mean_signal,
      R4(fixed_std) AS fixed_std, R4(temporal_std_mean) AS temporal_std_mean, R2(temporal_var_mean) AS temporal_var_mean,
      R4(frame_mean_std) AS frame_mean_std, R4(fano_temporal) AS fano_temporal, R6(fixed_to_temporal) AS fixed_to_temporal FROM grid""")
def _(t: Tables):
    return sel(grid(t), ["folder", "crop", "frames"], temporal_var_mean=2, fixed_to_temporal=6)


DELTA = ["mean_signal", "fixed_std", "temporal_std_mean", "temporal_var_mean", "fano_temporal"]


@query("robustness_delta", f"""WITH {GRID_CTE}
    SELECT g.folder, CAST(g.crop AS BIGINT) AS crop, CAST(g.frames AS BIGINT) AS frames,
      {", ".join(f"R6(abs((g.{m} - r.{m}) / r.{m})) AS {m}_change" for m in DELTA)}
    FROM grid g JOIN grid r ON g.folder = r.folder AND r.crop = 8 AND r.frames = 0""")
def _(t: Tables):
    return sel(T.robustness_delta(grid(t), (8, 0), DELTA), ["folder", "crop", "frames"], 6)


@query("strength_repeatability", f"""WITH {GRID_CTE},
    s AS (SELECT folder, frames, temporal_std_mean AS v FROM grid WHERE crop = 8),
    rk AS (SELECT folder, frames, rank() OVER (PARTITION BY frames ORDER BY v) AS k FROM s),
    rho AS (SELECT a.frames AS fa, b.frames AS fb, covar_pop(a.k, b.k) / (stddev_pop(a.k) * stddev_pop(b.k)) AS r
            FROM rk a JOIN rk b ON a.folder = b.folder AND a.frames < b.frames GROUP BY ALL)
    SELECT folder, R4(min(v)) AS strength_min, R4(max(v)) AS strength_max, R6(stddev_samp(v) / avg(v)) AS strength_cv,
      R6((max(v) - min(v)) / avg(v)) AS relative_range, R6((SELECT min(r) FROM rho)) AS min_order_correlation FROM s GROUP BY folder""")
def _(t: Tables):
    from pixelstrata.operators.inference import strength_repeatability
    s = grid(t).where("crop = 8").select("folder", "frames", F.col("temporal_std_mean").alias("v"))
    return sel(strength_repeatability(s, [16, 32, 0]), ["folder"], strength_cv=6, relative_range=6, min_order_correlation=6)


BINS_CTE = """
    fd AS (SELECT folder, y, x, var_samp(d) / 2 AS diff_var FROM (
        SELECT folder, y, x, dn - lag(dn) OVER (PARTITION BY folder, y, x ORDER BY frame) AS d FROM fx_frames) WHERE d IS NOT NULL GROUP BY ALL),
    sp AS (SELECT folder, quantile_cont(mean, 0.005) AS lo, quantile_cont(mean, 0.995) AS hi FROM fx_maps GROUP BY folder),
    bn AS (SELECT m.*, diff_var, least(CAST(floor((mean - lo) * 8 / (hi - lo)) AS BIGINT), 7) AS bin
           FROM fx_maps m JOIN sp USING (folder) JOIN fd USING (folder, y, x) WHERE mean >= lo AND mean <= hi),
    bins AS (SELECT folder, bin, count(*) AS pixel_count, avg(mean) AS mean_signal, avg(var1) AS temporal_var_mean,
        avg(std1) AS temporal_std_mean, coalesce(stddev_samp(mean), 0) AS spatial_mean_std, avg(diff_var) AS frame_diff_var_mean,
        median(var1) AS temporal_var_median FROM bn GROUP BY ALL HAVING count(*) >= 2)"""


def mv_bins(t: Tables):
    return T.mean_variance_bins(t.pixels_anywhere(), t.tiles(), 8, 2)


@query("mean_variance_bins", f"""WITH {BINS_CTE}
    SELECT folder, bin, pixel_count, R4(mean_signal) AS mean_signal, R2(temporal_var_mean) AS temporal_var_mean,
      R4(temporal_std_mean) AS temporal_std_mean, R4(spatial_mean_std) AS spatial_mean_std, R2(frame_diff_var_mean) AS frame_diff_var_mean,
      R2(temporal_var_median) AS temporal_var_median, R2(gv) AS global_total_pixel_var, R4(temporal_var_mean / mean_signal) AS fano_temporal
    FROM bins JOIN (SELECT folder, var_samp(dn) AS gv FROM fx_frames GROUP BY folder) USING (folder)""")
def _(t: Tables):
    return sel(mv_bins(t), ["folder", "bin"], temporal_var_mean=2, frame_diff_var_mean=2, temporal_var_median=2, global_total_pixel_var=2)


@query("linear_regime_fit", f"""WITH {BINS_CTE},
    fits AS (SELECT folder, count(*) OVER w AS linear_bin_count, regr_slope(temporal_var_mean, mean_signal) OVER w AS slope,
        regr_intercept(temporal_var_mean, mean_signal) OVER w AS intercept, regr_r2(temporal_var_mean, mean_signal) OVER w AS r2
        FROM bins WINDOW w AS (PARTITION BY folder ORDER BY mean_signal ROWS UNBOUNDED PRECEDING))
    SELECT folder, linear_bin_count, R4(slope) AS slope, R0(intercept) AS intercept, R6(r2) AS r2, R6(1 / slope) AS inverse_slope
    FROM fits WHERE linear_bin_count >= 3 AND slope > 0
    QUALIFY row_number() OVER (PARTITION BY folder ORDER BY r2 DESC, linear_bin_count) = 1""")
def _(t: Tables):
    return sel(T.linear_regime_fit(mv_bins(t)), ["folder"], slope=4, intercept=0, r2=6, inverse_slope=6)


@query("frame_difference_variance", """
    WITH d AS (SELECT folder, frame, y, x, dn - lag(dn) OVER (PARTITION BY folder, y, x ORDER BY frame) AS d FROM fx_frames),
      m AS (SELECT folder, y, x, var_samp(d) / 2 AS a, var_samp(CASE WHEN frame % 2 = 0 THEN d END) / 2 AS b FROM d WHERE d IS NOT NULL GROUP BY ALL)
    SELECT folder, R2(avg(var1)) AS direct_var, R2(avg(a)) AS difference_var, R2(avg(b)) AS disjoint_var,
      R6(covar_pop(var1, a) / (stddev_pop(var1) * stddev_pop(a))) AS map_correlation,
      R6((avg(a) - avg(var1)) / avg(var1)) AS relative_difference
    FROM fx_maps JOIN m USING (folder, y, x) GROUP BY folder""")
def _(t: Tables):
    return sel(T.frame_difference_variance(t.pixels_anywhere(), t.tiles()), ["folder"], 2, map_correlation=6, relative_difference=6)


@query("conditional_curve", """
    WITH e AS (SELECT pair_key, [quantile_cont(CAST(clean AS DOUBLE), 0.25), quantile_cont(CAST(clean AS DOUBLE), 0.5),
          quantile_cont(CAST(clean AS DOUBLE), 0.75)] AS q FROM fx_pairs GROUP BY pair_key),
      b AS (SELECT pair_key, (clean >= q[1])::INT + (clean >= q[2])::INT + (clean >= q[3])::INT AS bin, noisy - clean AS r
            FROM fx_pairs JOIN e USING (pair_key)),
      a AS (SELECT pair_key, bin, count(*) AS n, avg(r) AS m, var_pop(r) AS v FROM b GROUP BY ALL),
      f AS (SELECT k.pair_key, s.bin, a.n, a.m, a.v FROM (SELECT DISTINCT pair_key FROM fx_pairs) k
            CROSS JOIN (VALUES (0), (1), (2), (3)) s(bin) LEFT JOIN a ON a.pair_key = k.pair_key AND a.bin = s.bin)
    SELECT pair_key, CAST(bin AS BIGINT) AS bin, coalesce(n, 0) AS count, R4(m) AS residual_mean, R2(v) AS residual_var,
      R6(v / avg(v) OVER (PARTITION BY pair_key)) AS normalized_var,
      R6(count(v) OVER (PARTITION BY pair_key) / 4.0) AS valid_fraction FROM f""")
def _(t: Tables):
    from pixelstrata.operators.inference import conditional_curve
    return sel(conditional_curve(t.pairs(), ["pair_key"], "clean", F.col("noisy") - F.col("clean"), 4), ["pair_key", "bin"],
               6, residual_mean=4, residual_var=2)


@query("intensity_residual_bins", """
    WITH a AS (SELECT pair_key, least(CAST(floor(clean * 16 / 65535.0) AS BIGINT), 15) AS bin, noisy - clean AS r FROM fx_pairs),
      g AS (SELECT pair_key, bin, count(*) AS n, avg(r) AS m, var_pop(r) AS v FROM a GROUP BY ALL)
    SELECT k.pair_key, s.bin, coalesce(n, 0) AS count, R4(m) AS mean, R2(v) AS var, R4(s.bin * 4095.9375) AS bin_low
    FROM (SELECT DISTINCT pair_key FROM fx_pairs) k CROSS JOIN (SELECT range AS bin FROM range(16)) s
    LEFT JOIN g ON g.pair_key = k.pair_key AND g.bin = s.bin""")
def _(t: Tables):
    d = intensity_residual_bins(t.pairs(), ["pair_key"], "noisy", "clean", 16, RANGE)
    return sel(d.select("pair_key", "bin", "count", "mean", "var", "bin_low"), ["pair_key", "bin"], var=2)


@query("fixed_pattern_map", """
    SELECT folder, y, x, R4(mean - avg(mean) OVER (PARTITION BY folder)) AS fixed FROM fx_maps""")
def _(t: Tables):
    return sel(T.fixed_pattern_map(t.pixels_anywhere()), T.PIXEL)


@query("fixed_pattern_eval", """
    WITH p AS (SELECT f.*, frame <= frames // 2 AS train FROM fx_frames f JOIN fx_counts USING (folder)),
      fm AS (SELECT folder, y, x, m - avg(m) OVER (PARTITION BY folder) AS fixed
             FROM (SELECT folder, y, x, avg(dn) AS m FROM p WHERE train GROUP BY ALL)),
      mp AS (SELECT folder, y, x, count(*) AS n, avg(dn) AS mb, avg(dn - fixed) AS ma, stddev_samp(dn) AS tb,
               stddev_samp(dn - fixed) AS ta, any_value(fixed) AS fixed FROM p JOIN fm USING (folder, y, x) WHERE NOT train GROUP BY ALL),
      g AS (SELECT folder, max(n) AS n, avg(mb) AS mb, avg(ma) AS ma, stddev_samp(mb) AS sb, stddev_samp(ma) AS sa, avg(tb) AS tb,
              avg(ta) AS ta, stddev_samp(fixed) AS fs, avg(ma - mb) AS bias FROM mp GROUP BY folder)
    SELECT folder, n AS test_frames, R4(mb) AS mean_before, R4(ma) AS mean_after, R4(sb) AS spatial_std_before, R4(sa) AS spatial_std_after,
      R4(tb) AS temporal_std_before, R4(ta) AS temporal_std_after, R4(fs) AS fixed_map_std, R4(bias) AS bias,
      R6((sb - sa) / sb) AS spatial_reduction, R6((ta - tb) / tb) AS temporal_change,
      (sb - sa) / sb >= 0.5 AS passes_spatial, (ta - tb) / tb <= 0.1 AS passes_temporal FROM g""")
def _(t: Tables):
    return sel(T.fixed_pattern_eval(t.pixels_anywhere()), ["folder"], spatial_reduction=6, temporal_change=6)


BAD_CTE = """
    med AS (SELECT folder, median(mean) AS mm, median(std0) AS ms FROM fx_maps GROUP BY folder),
    lim AS (SELECT folder, mm + 3 * greatest(1.4826 * median(abs(mean - mm)), 1) AS lm,
              ms + 3 * greatest(1.4826 * median(abs(std0 - ms)), 1) AS ls FROM fx_maps JOIN med USING (folder) GROUP BY folder, mm, ms),
    bad AS (SELECT m.folder, m.y, m.x, hi >= 65535 AS saturated, lo <= 0 AS dead, mean > lm AS hot, std0 > ls AS unstable,
              hi >= 65535 OR lo <= 0 OR mean > lm OR std0 > ls AS bad
            FROM fx_maps m JOIN lim USING (folder)
            JOIN (SELECT folder, y, x, min(dn) AS lo, max(dn) AS hi FROM fx_frames GROUP BY ALL) r USING (folder, y, x))"""


@query("bad_pixel_mask", f"WITH {BAD_CTE} SELECT * FROM bad")
def _(t: Tables):
    return T.bad_pixel_mask(t.pixels_anywhere(), TOP, 3.0)


@query("background_audit", """
    WITH q AS (SELECT folder, quantile_cont(mean, 0.999) AS h, quantile_cont(std1, 0.999) AS u FROM fx_maps GROUP BY folder),
      f AS (SELECT folder, avg(s) AS sm, max(s) AS sx, max(m) - min(m) AS fr FROM (
        SELECT folder, frame, avg(dn) AS m, avg(CASE WHEN dn >= 65535 THEN 1.0 ELSE 0.0 END) AS s FROM fx_frames GROUP BY ALL) GROUP BY folder)
    SELECT folder, R4(h) AS hot_threshold, R4(u) AS unstable_threshold, R4(avg(mean)) AS mean, R4(stddev_samp(mean)) AS spatial_std,
      R4(avg(std1)) AS temporal_std, R6(avg(CASE WHEN mean > h THEN 1.0 ELSE 0.0 END)) AS hot_fraction,
      R6(avg(CASE WHEN std1 > u THEN 1.0 ELSE 0.0 END)) AS unstable_fraction, R6(any_value(sm)) AS saturation_mean,
      R6(any_value(sx)) AS saturation_max, R4(any_value(fr)) AS frame_mean_range
    FROM fx_maps JOIN q USING (folder) JOIN f USING (folder) GROUP BY folder, h, u""")
def _(t: Tables):
    return sel(T.background_audit(t.pixels_anywhere(), TOP), ["folder"], hot_fraction=6, unstable_fraction=6, saturation_mean=6, saturation_max=6)


RC_CTE = """
    rp AS (SELECT folder, frame, y, avg(r) AS p FROM fx_resid0 GROUP BY ALL),
    cp AS (SELECT folder, frame, x, avg(r) AS p FROM fx_resid0 GROUP BY ALL),
    blk AS (SELECT folder, block, frames, row_energy, column_energy FROM
        (SELECT folder, (frame - 1) // 8 AS block, count(DISTINCT frame) AS frames, sqrt(avg(p * p)) AS row_energy FROM rp GROUP BY ALL)
        JOIN (SELECT folder, (frame - 1) // 8 AS block, sqrt(avg(p * p)) AS column_energy FROM cp GROUP BY ALL) USING (folder, block)
        WHERE frames >= 2)"""


@query("row_column_energy", f"""WITH {RC_CTE},
    e AS (SELECT folder, re, ce FROM (SELECT folder, sqrt(avg(p * p)) AS re FROM rp GROUP BY folder)
          JOIN (SELECT folder, sqrt(avg(p * p)) AS ce FROM cp GROUP BY folder) USING (folder)),
    s AS (SELECT folder, stddev_samp(r) AS sb, stddev_samp(r - rp.p - cp.p) AS sa
          FROM fx_resid0 JOIN rp USING (folder, frame, y) JOIN cp USING (folder, frame, x) GROUP BY folder),
    c AS (SELECT folder, stddev_samp(row_energy) / avg(row_energy) AS rcv, stddev_samp(column_energy) / avg(column_energy) AS ccv FROM blk GROUP BY folder)
    SELECT folder, R4(re) AS row_energy, R4(ce) AS column_energy, R4(sb) AS std_before, R4(sa) AS std_after, R6(rcv) AS row_block_cv,
      R6(ccv) AS column_block_cv, R6(1 - sa * sa / (sb * sb)) AS variance_removed FROM e JOIN s USING (folder) JOIN c USING (folder)""")
def _(t: Tables):
    s, _b = T.row_column_energy(T.temporal_residual(t.pixels()), 8)
    return sel(s, ["folder"], row_block_cv=6, column_block_cv=6, variance_removed=6)


@query("row_column_blocks", f"""WITH {RC_CTE} SELECT folder, block, frames, R4(row_energy) AS row_energy, R4(column_energy) AS column_energy FROM blk""")
def _(t: Tables):
    _s, b = T.row_column_energy(T.temporal_residual(t.pixels()), 8)
    return sel(b, ["folder", "block"])


def _corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


@query("profile_adjacent_corr", f"""WITH {RC_CTE},
    a AS (SELECT folder, avg(c) AS rc FROM (SELECT a.folder, a.frame, {_corr('a.p', 'b.p')} AS c
        FROM rp a JOIN rp b ON a.folder = b.folder AND a.y = b.y AND b.frame = a.frame + 1 GROUP BY a.folder, a.frame) GROUP BY folder),
    b AS (SELECT folder, avg(c) AS cc FROM (SELECT a.folder, a.frame, {_corr('a.p', 'b.p')} AS c
        FROM cp a JOIN cp b ON a.folder = b.folder AND a.x = b.x AND b.frame = a.frame + 1 GROUP BY a.folder, a.frame) GROUP BY folder)
    SELECT folder, R6(rc) AS row_correlation, R6(cc) AS column_correlation FROM a JOIN b USING (folder)""")
def _(t: Tables):
    return sel(T.profile_adjacent_corr(T.temporal_residual(t.pixels())), ["folder"], 6)


@query("frame_trace", """
    SELECT folder, frame, R4(mean) AS mean, R4(std) AS std,
      R4(avg(mean) OVER (PARTITION BY folder ORDER BY frame ROWS 9 PRECEDING)) AS rolling_mean,
      R2(avg(var) OVER (PARTITION BY folder ORDER BY frame ROWS 9 PRECEDING)) AS rolling_variance FROM fx_fstat""")
def _(t: Tables):
    s = T.frame_trace(T.frame_stats(t.pixels()), 10).drop("n", "var")
    return sel(s, T.FRAME, rolling_variance=2)


@query("event_trace", """
    SELECT folder, frame, value, R4(avg(value) OVER (PARTITION BY folder ORDER BY frame ROWS 9 PRECEDING)) AS rolling_mean FROM fx_trace""")
def _(t: Tables):
    s = t.trace().select("folder", "frame", "value", F.col("value").alias("mean"), F.lit(0.0).alias("var"))
    return sel(T.frame_trace(s, 10, chunk=4096).select("folder", "frame", "value", "rolling_mean"), ["folder", "frame"])


@query("drift_summary", """
    WITH h AS (SELECT s.*, frame > frames // 2 AS second FROM fx_fstat s JOIN fx_counts USING (folder)),
      g AS (SELECT folder, regr_slope(mean, frame) AS ms, regr_slope(std, frame) AS ss, avg(mean) FILTER (NOT second) AS a,
              avg(mean) FILTER (second) AS b, avg(std) FILTER (second) - avg(std) FILTER (NOT second) AS sd FROM h GROUP BY folder),
      l AS (SELECT folder, max(abs((b - a) / a)) AS mx FROM (
        SELECT folder, y // 4 AS gy, x // 4 AS gx, avg(dn) FILTER (frame <= frames // 2) AS a, avg(dn) FILTER (frame > frames // 2) AS b
        FROM fx_frames JOIN fx_counts USING (folder) GROUP BY ALL) GROUP BY folder)
    SELECT folder, R4(ms) AS mean_slope, R4(ss) AS std_slope, R4(a) AS first_half, R4(b) AS second_half, R4(sd) AS std_delta,
      R4(b - a) AS mean_delta, R6((b - a) / a) AS relative_change, R6(mx) AS max_local_change, abs((b - a) / a) > 0.01 AS drift_flag
    FROM g JOIN l USING (folder)""")
def _(t: Tables):
    return sel(T.drift_summary(t.pixels(), 4, 4), ["folder"], relative_change=6, max_local_change=6)


LAGS = [1, 8, 32]


@query("lag_correlation", f"""
    WITH p AS (SELECT a.folder, a.frame, l.lag, {_corr('a.r', 'b.r')} AS c FROM fx_resid0 a CROSS JOIN (VALUES (1), (8), (32)) l(lag)
      JOIN fx_resid0 b ON a.folder = b.folder AND a.y = b.y AND a.x = b.x AND b.frame = a.frame + l.lag GROUP BY ALL)
    SELECT folder, CAST(lag AS BIGINT) AS lag, count(c) AS pairs, R6(avg(c)) AS correlation_mean, R6(max(abs(c))) AS correlation_max_abs
    FROM p GROUP BY ALL""")
def _(t: Tables):
    return sel(T.lag_correlation(tile_residual(tiles := t.tiles(), shape=frame_shape(tiles)), LAGS), ["folder", "lag"], 6)


@query("lag_correlation_by_brightness", f"""
    WITH e AS (SELECT folder, quantile_cont(mean, 0.25) AS e1, quantile_cont(mean, 0.5) AS e2, quantile_cont(mean, 0.75) AS e3 FROM fx_maps GROUP BY folder),
      b AS (SELECT folder, y, x, CAST((mean >= e1)::INT + (mean >= e2)::INT + (mean >= e3)::INT AS BIGINT) AS bin FROM fx_maps JOIN e USING (folder)),
      p AS (SELECT a.folder, a.frame, l.lag, bin, {_corr('a.r', 'b.r')} AS c FROM fx_resid0 a CROSS JOIN (VALUES (1), (8)) l(lag)
        JOIN fx_resid0 b ON a.folder = b.folder AND a.y = b.y AND a.x = b.x AND b.frame = a.frame + l.lag
        JOIN b k ON k.folder = a.folder AND k.y = a.y AND k.x = a.x GROUP BY ALL)
    SELECT folder, CAST(lag AS BIGINT) AS lag, bin, R6(avg(c)) AS correlation_mean, R6(max(abs(c))) AS correlation_max_abs FROM p GROUP BY ALL""")
def _(t: Tables):
    tiles = t.tiles()
    return sel(T.lag_correlation_by_brightness(tiles, tile_residual(tiles, shape=frame_shape(tiles)), [1, 8], 4), ["folder", "lag", "bin"], 6)


@query("lag_difference_moments", """
    WITH d AS (SELECT a.folder, l.lag, CAST(b.dn - a.dn AS DOUBLE) AS d FROM fx_frames a CROSS JOIN (VALUES (1), (8), (32)) l(lag)
        JOIN fx_frames b ON a.folder = b.folder AND a.y = b.y AND a.x = b.x AND b.frame = a.frame + l.lag),
      m AS (SELECT folder, lag, count(*) AS n, avg(d) AS mean, stddev_pop(d) AS std FROM d GROUP BY ALL),
      c AS (SELECT d.folder, d.lag, any_value(n)::DOUBLE AS n, any_value(mean) AS mean, any_value(std) AS std,
              avg(pow((d - mean) / std, 3)) AS sk, avg(pow((d - mean) / std, 4)) - 3 AS ku FROM d JOIN m USING (folder, lag) GROUP BY ALL)
    SELECT folder, CAST(lag AS BIGINT) AS lag, CAST(n AS BIGINT) AS n, R4(mean) AS mean, R4(std) AS std,
      R6(sk * sqrt(n * (n - 1)) / (n - 2)) AS skewness, R6(((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * ku + 6)) AS excess_kurtosis
    FROM c WHERE n > 3""")
def _(t: Tables):
    return sel(T.lag_difference_moments(t.tiles(), LAGS), ["folder", "lag"], skewness=6, excess_kurtosis=6)


SUBSETS = ["all", "odd", "even", "first_half", "second_half", "middle_half", "block_a", "block_b", "hashed_half"]
SUBSET_CTE = """
    tag AS (SELECT folder, frame, unnest(list_filter([
        'all', CASE WHEN frame % 2 = 1 THEN 'odd' END, CASE WHEN frame % 2 = 0 THEN 'even' END,
        CASE WHEN frame <= frames // 2 THEN 'first_half' END, CASE WHEN frame > frames // 2 THEN 'second_half' END,
        CASE WHEN frame > frames // 4 AND frame <= frames // 4 + frames // 2 THEN 'middle_half' END,
        CASE WHEN ((frame - 1) // 8) % 2 = 0 THEN 'block_a' END, CASE WHEN ((frame - 1) // 8) % 2 = 1 THEN 'block_b' END,
        CASE WHEN ('0x' || substr(md5(folder || ':' || frame), 1, 4))::UBIGINT % 2 = 0 THEN 'hashed_half' END], lambda v: v IS NOT NULL)) AS subset
        FROM (SELECT DISTINCT folder, frame FROM fx_frames) JOIN fx_counts USING (folder))"""


@query("frame_subset", f"""WITH {SUBSET_CTE}
    SELECT subset, folder, count(DISTINCT frame) AS frames, R4(avg(dn)) AS mean, R4(stddev_pop(dn)) AS std
    FROM fx_frames JOIN tag USING (folder, frame) GROUP BY ALL""")
def _(t: Tables):
    s = T.frame_subsets(t.pixels_anywhere(), SUBSETS, block=8).groupBy("subset", "folder", "frame").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dn").alias("s"), F.sum(F.col("dn") * F.col("dn")).alias("ss"))
    n, m = F.sum("n"), F.sum("s") / F.sum("n")
    g = s.groupBy("subset", "folder").agg(F.count(F.lit(1)).alias("frames"), m.alias("mean"), F.sqrt(F.sum("ss") / n - m * m).alias("std"))
    return sel(g, ["subset", "folder"])


HP_CTE = """
    kern AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM (SELECT range - 4 AS k FROM range(9))),
    refl AS (SELECT i, k, w, CASE WHEN i + k < 0 THEN -1 - (i + k) WHEN i + k >= 8 THEN 15 - (i + k) ELSE i + k END AS j
             FROM kern, (SELECT range AS i FROM range(8)))"""

SPLIT_CTE = SUBSET_CTE + "," + HP_CTE + """,
    sm AS (SELECT folder, subset, y, x, avg(dn) AS v FROM fx_frames JOIN tag USING (folder, frame)
           WHERE subset NOT IN ('all', 'middle_half', 'hashed_half') GROUP BY ALL),
    b1 AS (SELECT folder, subset, i AS y, x, sum(w * v) AS v FROM sm JOIN refl ON y = j GROUP BY ALL),
    b2 AS (SELECT folder, subset, y, i AS x, sum(w * v) AS low FROM b1 JOIN refl ON x = j GROUP BY ALL),
    hp AS (SELECT folder, CASE WHEN subset IN ('odd', 'even') THEN 'odd_even' WHEN subset LIKE '%half' THEN 'halves' ELSE 'blocks' END AS split,
             subset IN ('odd', 'first_half', 'block_a') AS first, y, x, v - low AS h FROM sm JOIN b2 USING (folder, subset, y, x)),
    pr AS (SELECT a.folder, a.split, a.h AS a, b.h AS b FROM hp a JOIN hp b USING (folder, split, y, x) WHERE a.first AND NOT b.first),
    per AS (SELECT folder, split, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS correlation, stddev_samp((a + b) / 2) AS stable_std,
              stddev_samp((a - b) / sqrt(2)) AS difference_std FROM pr GROUP BY ALL)"""


@query("split_map_repeatability", f"""WITH {SPLIT_CTE}
    SELECT folder, R6(min(correlation)) AS min_correlation, R6(median(correlation)) AS median_correlation, R4(median(stable_std)) AS stable_std,
      R4(median(difference_std)) AS difference_std, R6(median(stable_std) / median(difference_std)) AS ratio,
      min(correlation) < 0.5 AS low_repeatability FROM per GROUP BY folder""")
def _(t: Tables):
    _p, f = T.split_map_repeatability(t.pixels_anywhere(), 1.0, 8)
    return sel(f, ["folder"], min_correlation=6, median_correlation=6, ratio=6)


@query("split_map_by_method", f"""WITH {SPLIT_CTE}
    SELECT folder, split, R6(correlation) AS correlation, R4(stable_std) AS stable_std, R4(difference_std) AS difference_std,
      R6(stable_std / difference_std) AS ratio FROM per""")
def _(t: Tables):
    p, _f = T.split_map_repeatability(t.pixels_anywhere(), 1.0, 8)
    return sel(p, ["folder", "split"], correlation=6, ratio=6)


@query("frame_consistency", f"""
    WITH d AS (SELECT folder, frame, dn, lag(dn) OVER (PARTITION BY folder, y, x ORDER BY frame) AS prev FROM fx_frames),
      c AS (SELECT folder, avg(c) AS c FROM (SELECT folder, frame, {_corr('prev', 'dn')} AS c FROM d WHERE prev IS NOT NULL GROUP BY ALL) GROUP BY folder)
    SELECT folder, R4(stddev_pop(dn - prev)) AS difference_std, R4(avg(abs(dn - prev))) AS difference_mae, R6(any_value(c)) AS adjacent_correlation
    FROM d JOIN c USING (folder) WHERE prev IS NOT NULL GROUP BY folder""")
def _(t: Tables):
    return sel(T.frame_consistency(t.tiles()), ["folder"], adjacent_correlation=6)


CONV = ["temporal_std", "mean_signal", "row_energy", "column_energy"]
CONV_SUBSETS = ["all", "odd", "even", "first_half", "second_half"]


BANDS = ["low_fraction", "mid_fraction", "high_fraction"]


def lag_one(other: str) -> str:
    return f"sum(r * {other}) / sqrt(sum(r * r) FILTER ({other} IS NOT NULL) * sum({other} * {other}))"


@query("frame_convergence", f"""WITH {SUBSET_CTE},
    s AS (SELECT * FROM fx_frames JOIN tag USING (folder, frame) WHERE subset IN ('all', 'odd', 'even', 'first_half', 'second_half')),
    m AS (SELECT folder, subset, y, x, avg(dn) AS m, stddev_samp(dn) AS sd FROM s GROUP BY ALL),
    r AS (SELECT s.folder, s.subset, s.frame, s.y, s.x, dn - m - avg(dn - m) OVER (PARTITION BY s.folder, s.subset, s.frame) AS r
          FROM s JOIN m USING (folder, subset, y, x)),
    re AS (SELECT folder, subset, sqrt(avg(p * p)) AS row_energy FROM (SELECT folder, subset, frame, y, avg(r) AS p FROM r GROUP BY ALL) GROUP BY ALL),
    ce AS (SELECT folder, subset, sqrt(avg(p * p)) AS column_energy FROM (SELECT folder, subset, frame, x, avg(r) AS p FROM r GROUP BY ALL) GROUP BY ALL),
    nb AS (SELECT *, lead(r1) OVER (PARTITION BY folder, subset, frame, x ORDER BY y) AS d, lead(r) OVER (PARTITION BY folder, subset, frame, x ORDER BY y) AS v
          FROM (SELECT *, lead(r) OVER (PARTITION BY folder, subset, frame, y ORDER BY x) AS r1 FROM r)),
    ac AS (SELECT folder, subset, ({lag_one('r1')} + {lag_one('v')} + 2 * {lag_one('d')}) / 4 AS acf1 FROM nb GROUP BY ALL),
    hw AS (SELECT folder, subset, frame, y, x, r * {HANN} AS r FROM r), {DFT.format(name='ps', k='folder, subset', r='r', src='hw')},
    bf AS (SELECT folder, subset, {BANDS_SQL} FROM (SELECT folder, subset, p, {FREQ} AS f FROM ps) GROUP BY ALL),
    mc AS (SELECT m.folder, m.subset, {_corr('m.sd', 'f.sd')} AS map_correlation FROM m JOIN m f ON m.folder = f.folder AND m.y = f.y AND m.x = f.x AND f.subset = 'all' GROUP BY ALL),
    a AS (SELECT * FROM (SELECT folder, subset, avg(sd) AS temporal_std, avg(m) AS mean_signal FROM m GROUP BY ALL)
          JOIN re USING (folder, subset) JOIN ce USING (folder, subset) JOIN ac USING (folder, subset) JOIN bf USING (folder, subset) JOIN mc USING (folder, subset))
    SELECT a.folder, a.subset, {", ".join(f"R6((a.{m} - f.{m}) / f.{m}) AS {m}_error" for m in CONV)},
      {", ".join(f"R6(abs(a.{m} - f.{m})) AS {m}_error" for m in ["acf1", *BANDS])}, R6(a.map_correlation) AS map_correlation
    FROM a JOIN a f ON a.folder = f.folder AND f.subset = 'all'""".replace("R8(", "("))
def _(t: Tables):
    d = T.subset_noise(t.tiles(), CONV_SUBSETS, EDGES)
    return sel(T.frame_convergence(d, CONV, ["acf1", *BANDS], ["map_correlation"]), ["folder", "subset"], 6)


@query("frame_count_recommendation", f"""WITH {GRID_CTE},
    e AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, g.frames, abs((g.{m} - r.{m}) / r.{m}) AS err FROM grid g JOIN grid r ON g.folder = r.folder AND g.crop = r.crop AND r.frames = 0" for m in ["temporal_std_mean", "fixed_std", "mean_signal"])}),
    s AS (SELECT metric, frames, avg(CASE WHEN err <= 0.05 THEN 1.0 ELSE 0.0 END) AS share FROM e GROUP BY ALL)
    SELECT metric, coalesce(min(CASE WHEN share >= 0.8 AND frames > 0 THEN frames END), 0)::BIGINT AS recommended, R6(max(share)) AS best_share
    FROM s GROUP BY metric""")
def _(t: Tables):
    return sel(T.frame_count_recommendation(grid(t), ["temporal_std_mean", "fixed_std", "mean_signal"], 0.05, 0.8), ["metric"], 6)


SCHEMES = {"single_to_single": (1, 1), "single_to_8mean": (1, 8), "single_to_16mean": (1, 16), "8mean_to_8mean": (8, 8)}
TARGET_CTE = f"""
    e AS (SELECT f.*, s.k, s.a, s.w, frames, (frame - 1) // s.w AS block FROM fx_frames f JOIN fx_counts USING (folder),
          (VALUES {", ".join(f"('{k}', {a}, {a + b})" for k, (a, b) in SCHEMES.items())}) s(k, a, w) WHERE ((frame - 1) // s.w + 1) * s.w <= frames),
    tot AS (SELECT folder, y, x, sum(dn) AS st FROM fx_frames GROUP BY ALL),
    b AS (SELECT folder, k, block, y, x, a, w, frames, sum(CASE WHEN (frame - 1) % w < a THEN dn ELSE 0 END) AS si, sum(dn) AS sb FROM e GROUP BY ALL),
    c AS (SELECT folder, k, block, si / a AS i, (sb - si) / (w - a) AS t, (st - sb) / nullif(frames - w, 0) AS c FROM b JOIN tot USING (folder, y, x)),
    per AS (SELECT folder, k, block, stddev_pop(i - c) AS i, stddev_pop(t - c) AS t, avg(t - c) AS b, stddev_pop(i - t) AS d FROM c GROUP BY ALL),
    tc AS (SELECT folder, k AS scheme, count(*) AS pairs, avg(i) AS input_std, avg(t) AS target_std, avg(b) AS target_bias, avg(d) AS difference_std
           FROM per GROUP BY ALL)"""


@query("target_candidates", f"""WITH {TARGET_CTE}
    SELECT folder, scheme, pairs, R4(input_std) AS input_std, R4(target_std) AS target_std, R4(target_bias) AS target_bias,
      R4(difference_std) AS difference_std FROM tc""")
def _(t: Tables):
    return sel(T.target_candidates(t.pixels_anywhere(), SCHEMES), ["folder", "scheme"])


@query("repeated_frame_gate", f"""WITH {TARGET_CTE}, {RC_CTE},
    lc AS (SELECT folder, avg(c) AS c FROM (SELECT a.folder, a.frame, {_corr('a.r', 'b.r')} AS c FROM fx_resid0 a
        JOIN fx_resid0 b ON a.folder = b.folder AND a.y = b.y AND a.x = b.x AND b.frame = a.frame + 1 GROUP BY ALL) GROUP BY folder),
    pr AS (SELECT folder, avg(c) AS c FROM (SELECT a.folder, a.frame, {_corr('a.p', 'b.p')} AS c
        FROM rp a JOIN rp b ON a.folder = b.folder AND a.y = b.y AND b.frame = a.frame + 1 GROUP BY a.folder, a.frame) GROUP BY folder),
    pc AS (SELECT folder, avg(c) AS c FROM (SELECT a.folder, a.frame, {_corr('a.p', 'b.p')} AS c
        FROM cp a JOIN cp b ON a.folder = b.folder AND a.x = b.x AND b.frame = a.frame + 1 GROUP BY a.folder, a.frame) GROUP BY folder),
    dr AS (SELECT folder, abs(avg(mean) FILTER (frame > frames // 2) - avg(mean) FILTER (frame <= frames // 2)) AS d
           FROM fx_fstat JOIN fx_counts USING (folder) GROUP BY folder),
    ld AS (SELECT folder, max(abs(b - a)) AS d FROM (SELECT folder, y // 4 AS gy, x // 4 AS gx, avg(dn) FILTER (frame <= frames // 2) AS a,
        avg(dn) FILTER (frame > frames // 2) AS b FROM fx_frames JOIN fx_counts USING (folder) GROUP BY ALL) GROUP BY folder),
    fm AS (SELECT folder, {_corr('a', 'b')} AS c FROM (SELECT folder, y, x, avg(dn) FILTER (frame <= frames // 2) AS a,
        avg(dn) FILTER (frame > frames // 2) AS b FROM fx_frames JOIN fx_counts USING (folder) GROUP BY ALL) GROUP BY folder),
    ts AS (SELECT folder, avg(std0) AS s FROM fx_maps GROUP BY folder),
    red AS (SELECT folder, max(target_std) FILTER (scheme = 'single_to_single') / greatest(max(target_std) FILTER (scheme = 'single_to_8mean'), 1e-12) AS r
            FROM tc GROUP BY folder),
    chk AS (SELECT folder, s, r, dr.d / s <= 0.5 AS global_drift, ld.d / s <= 1.0 AS local_drift, abs(lc.c) <= 0.05 AS residual_independence,
        greatest(abs(pr.c), abs(pc.c)) <= 0.2 AS row_column_independence, coalesce(fm.c, 0) >= 0.2 AS fixed_map_stable
        FROM ts JOIN dr USING (folder) JOIN ld USING (folder) JOIN lc USING (folder) JOIN pr USING (folder) JOIN pc USING (folder)
        JOIN fm USING (folder) JOIN red USING (folder))
    SELECT *, row_number() OVER (ORDER BY s, folder) = 1 AS is_low, row_number() OVER (ORDER BY s, folder) = (count(*) OVER () - 1) // 2 + 1 AS is_mid,
      row_number() OVER (ORDER BY s, folder) = count(*) OVER () AS is_high
    FROM (SELECT folder, R4(s) AS temporal_std, R4(r) AS noise_reduction, global_drift, local_drift, residual_independence, row_column_independence,
        fixed_map_stable, global_drift AND local_drift AND residual_independence AND row_column_independence AND fixed_map_stable AS passed, s FROM chk)
    """.replace("SELECT *, row_number", "SELECT * EXCLUDE (s), row_number"))
def _(t: Tables):
    from pixelstrata.operators.decisions import repeated_frame_gate
    px = t.pixels()
    res, tiles = T.temporal_residual(px), t.tiles()
    d = repeated_frame_gate(
        px, T.lag_correlation(tile_residual(tiles, shape=frame_shape(tiles)), [1]), T.profile_adjacent_corr(res), T.target_candidates(px, SCHEMES),
        dict(global_drift=0.5, local_drift=1.0, residual=0.05, row_column=0.2, fixed_map=0.2), grid=4)
    return sel(d, ["folder"])


@query("registration_shift")
def _(t: Tables):
    return sel(T.registration_shift(t.tiles(), 8), ["folder"])


def raw_out(t: Tables):
    """Predictions with the noisy frame as raw input, keyed by strategy and frame."""
    return t.predictions().select("strategy", "folder", "frame", "y", "x", F.col("noisy").alias("raw"), "value")


@query("temporal_reduction", """
    WITH a AS (SELECT *, noisy - avg(noisy) OVER w AS nc, value - avg(value) OVER w AS vc, value - avg(value) OVER w + avg(noisy) OVER w AS vr
        FROM fx_pred WINDOW w AS (PARTITION BY strategy, pair_key)),
      m AS (SELECT strategy, folder, y, x, var_pop(noisy) AS n, var_pop(value) AS v, var_pop(nc) AS nc, var_pop(vc) AS vc, var_pop(vr) AS vr FROM a GROUP BY ALL)
    SELECT strategy, folder, R6(1 - avg(v) / avg(n)) AS reduction, R6(1 - avg(vc) / avg(nc)) AS centered_reduction,
      R6(1 - avg(vr) / avg(n)) AS restored_reduction FROM m GROUP BY ALL""")
def _(t: Tables):
    return sel(T.temporal_reduction(raw_out(t)), ["strategy", "folder"], 6)


RANGES = {"first_quarter": (0, 0.25), "first_half": (0, 0.5), "all": (0, 1), "second_half": (0.5, 1), "middle": (0.25, 0.75)}


@query("prefix_references", f"""
    SELECT folder, k AS reference, y, x, count(*) AS frames, R4(avg(dn)) AS mean FROM fx_frames JOIN fx_counts USING (folder),
      (VALUES {", ".join(f"('{k}', {a}, {b})" for k, (a, b) in RANGES.items())}) r(k, a, b)
    WHERE frame > floor(frames * CAST(a AS DOUBLE)) AND frame <= floor(frames * CAST(b AS DOUBLE)) GROUP BY ALL""")
def _(t: Tables):
    return sel(T.prefix_references(t.pixels_anywhere(), RANGES), ["folder", "reference", "y", "x"])


@query("odd_even_references", """
    WITH m AS (SELECT folder, y, x, avg(dn) FILTER (frame % 2 = 1) AS a, avg(dn) FILTER (frame % 2 = 0) AS b FROM fx_frames GROUP BY ALL),
      g AS (SELECT folder, avg(sqrt(ax * ax + ay * ay)) / avg(sqrt(bx * bx + b_y * b_y)) AS ratio FROM (
        SELECT folder, CASE WHEN lag(a) OVER r IS NULL THEN lead(a) OVER r - a WHEN lead(a) OVER r IS NULL THEN a - lag(a) OVER r ELSE (lead(a) OVER r - lag(a) OVER r) / 2 END AS ax,
          CASE WHEN lag(a) OVER c IS NULL THEN lead(a) OVER c - a WHEN lead(a) OVER c IS NULL THEN a - lag(a) OVER c ELSE (lead(a) OVER c - lag(a) OVER c) / 2 END AS ay,
          CASE WHEN lag(b) OVER r IS NULL THEN lead(b) OVER r - b WHEN lead(b) OVER r IS NULL THEN b - lag(b) OVER r ELSE (lead(b) OVER r - lag(b) OVER r) / 2 END AS bx,
          CASE WHEN lag(b) OVER c IS NULL THEN lead(b) OVER c - b WHEN lead(b) OVER c IS NULL THEN b - lag(b) OVER c ELSE (lead(b) OVER c - lag(b) OVER c) / 2 END AS b_y
        FROM m WINDOW r AS (PARTITION BY folder, y ORDER BY x), c AS (PARTITION BY folder, x ORDER BY y)) GROUP BY folder)
    SELECT folder, R4(20 * log10(65535.0) - 10 * log10(avg((a - b) * (a - b)))) AS psnr,
      R6((2 * avg(a) * avg(b) + 429483.6225) * (2 * covar_pop(a, b) + 3865352.6025) /
         ((avg(a) * avg(a) + avg(b) * avg(b) + 429483.6225) * (var_pop(a) + var_pop(b) + 3865352.6025))) AS ssim,
      R6(any_value(ratio)) AS gradient_ratio FROM m JOIN g USING (folder) GROUP BY folder""")
def _(t: Tables):
    from pixelstrata.functions.scalars import psnr_from_mse, ratio
    odd = F.col("frame") % 2 == 1
    m = t.pixels_anywhere().groupBy(*T.PIXEL).agg(F.avg(F.when(odd, F.col("dn"))).alias("a"), F.avg(F.when(~odd, F.col("dn"))).alias("b"))
    d = F.col("a") - F.col("b")
    q = m.groupBy("folder").agg(F.avg(d * d).alias("_mse"), ssim_global_agg("a", "b", RANGE).alias("ssim"))
    ga = central_gradient(m, ["folder"], "a").groupBy("folder").agg(F.avg("grad").alias("_a"))
    gb = central_gradient(m, ["folder"], "b").groupBy("folder").agg(F.avg("grad").alias("_b"))
    out = q.join(ga, "folder").join(gb, "folder").select(
        "folder", psnr_from_mse("_mse", RANGE).alias("psnr"), "ssim", ratio("_a", "_b").alias("gradient_ratio"))
    return sel(out, ["folder"], 6, psnr=4)


@query("surrogate_pairs", """
    WITH c AS (SELECT folder, y, x, CAST(round_even(avg(dn), 0) AS BIGINT) AS clean FROM fx_frames JOIN fx_counts USING (folder)
        WHERE frame <= frames // 2 GROUP BY ALL)
    SELECT 'folder_' || folder || '_frame_' || frame AS pair_key, folder, frame, any_value(frames // 2) AS reference_frames,
      count(*) AS pixels, R4(avg(clean)) AS clean_mean, R4(avg(dn - clean)) AS residual_mean, R4(stddev_pop(dn - clean)) AS residual_std
    FROM fx_frames JOIN fx_counts USING (folder) JOIN c USING (folder, y, x) WHERE frame > frames // 2 GROUP BY folder, frame""")
def _(t: Tables):
    p = surrogate_pairs(t.pixels_anywhere())
    r = F.col("noisy") - F.col("clean")
    g = p.groupBy("pair_key", "folder", "frame").agg(
        F.max("reference_frames").alias("reference_frames"), F.count(F.lit(1)).alias("pixels"), F.avg("clean").alias("clean_mean"),
        F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"))
    return sel(g, ["pair_key", "folder", "frame"])
