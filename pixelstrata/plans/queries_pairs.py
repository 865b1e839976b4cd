"""Pair quality and residual queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelstrata.functions.scalars import corr_agg, rnd
from pixelstrata.operators import pairs as P
from pixelstrata.operators import spectral as S
from pixelstrata.operators.frames import tile_pixels
from pixelstrata.operators.tiles import PLACE, frame_shape
from pixelstrata.plans.queries_pixels import TARGET_STD_CTE, VALID_CTE, masked, with_target
from pixelstrata.plans.queries_temporal import TOP, _corr, raw_out, sel
from pixelstrata.plans.fourier_sql import DFT, RAD
from pixelstrata.plans.registry import query
from pixelstrata.plans.views import RANGE, Tables

K = ["pair_key"]
SK = ["strategy", "pair_key"]
C1, C2 = (0.01 * RANGE) ** 2, (0.03 * RANGE) ** 2
PSNR = "20 * log10(65535.0) - 10 * log10(greatest(avg(({a} - {b})::DOUBLE * ({a} - {b})), 1e-12))"


def psnr_sql(a: str, b: str) -> str:
    mse = f"avg(({a} - {b})::DOUBLE * ({a} - {b}))"
    return f"CASE WHEN {mse} <= 1e-12 THEN 'Infinity'::DOUBLE ELSE 20 * log10(65535.0) - 10 * log10({mse}) END"


def ssim_sql(a: str, b: str) -> str:
    return (f"(2 * avg({a}) * avg({b}) + {C1}) * (2 * covar_pop({a}, {b}) + {C2}) / "
            f"((avg({a}) * avg({a}) + avg({b}) * avg({b}) + {C1}) * (var_pop({a}) + var_pop({b}) + {C2}))")


def windowed_ssim_cte(src: str, keys: str, a: str, b: str, name: str, radius: int = 3) -> str:
    """CTE <name>(keys, ssim): mean windowed SSIM of 8 x 8 images."""
    n = (2 * radius + 1) ** 2
    lo, hi = radius, 7 - radius
    cols = {"sa": a, "sb": b, "saa": f"{a} * {a}", "sbb": f"{b} * {b}", "sab": f"{a} * {b}"}
    one = ", ".join(f"sum(({e})::DOUBLE) OVER r AS {c}" for c, e in cols.items())
    two = ", ".join(f"sum({c}) OVER c / {n} AS {c}" for c in cols)
    u = f"{n}.0::DOUBLE / {n - 1}"
    return f"""
    {name}1 AS (SELECT {keys}, y, x, {one} FROM {src} WINDOW r AS (PARTITION BY {keys}, y ORDER BY x ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)),
    {name}2 AS (SELECT {keys}, y, x, {two} FROM {name}1 WINDOW c AS (PARTITION BY {keys}, x ORDER BY y ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)),
    {name} AS (SELECT {keys}, avg((2 * sa * sb + {C1}) * (2 * {u} * (sab - sa * sb) + {C2}) /
        ((sa * sa + sb * sb + {C1}) * ({u} * (saa - sa * sa) + {u} * (sbb - sb * sb) + {C2}))) AS ssim
      FROM {name}2 WHERE y BETWEEN {lo} AND {hi} AND x BETWEEN {lo} AND {hi} GROUP BY {keys})"""


@query("psnr", f"""
    SELECT strategy, pair_key, R6(avg((value - clean)::DOUBLE * (value - clean)) / 1e6) AS mse_m, CAST(0 AS BIGINT) AS unmatched,
      R6({psnr_sql('value', 'clean')}) AS psnr FROM fx_pred GROUP BY strategy, pair_key""")
def _(t: Tables):
    p = P.psnr(t.predictions(), SK, "value", "clean", RANGE)
    return p.select(*SK, rnd(F.col("mse") / 1e6, 6).alias("mse_m"), "unmatched", rnd("psnr", 6).alias("psnr"))


@query("ssim_global", f"SELECT strategy, pair_key, R8({ssim_sql('value', 'clean')}) AS ssim FROM fx_pred GROUP BY strategy, pair_key")
def _(t: Tables):
    return sel(t.predictions().groupBy(*SK).agg(P.ssim_global_agg("value", "clean", RANGE).alias("ssim")), SK, 8)


@query("ssim_windowed", f"WITH {windowed_ssim_cte('fx_pairs', 'pair_key', 'noisy', 'clean', 'ws')} SELECT pair_key, R8(ssim) AS ssim FROM ws")
def _(t: Tables):
    return sel(P.ssim_windowed(t.pairs(), K, "noisy", "clean", RANGE), K, 8)


@query("residual_stats", """
    SELECT pair_key, R4(avg(noisy - clean)) AS residual_mean, R4(stddev_pop(noisy - clean)) AS residual_std, R1(var_pop(noisy - clean)) AS residual_var,
      R4(avg(abs(noisy - clean))) AS residual_mae, R4(quantile_cont((noisy - clean)::DOUBLE, 0.01)) AS p01,
      R4(quantile_cont((noisy - clean)::DOUBLE, 0.5)) AS p50, R4(quantile_cont((noisy - clean)::DOUBLE, 0.99)) AS p99 FROM fx_pairs GROUP BY pair_key""")
def _(t: Tables):
    return sel(P.residual_stats(t.pairs(), K, "noisy", "clean"), K, 4, residual_var=1)


@query("brightness_bin_psnr", f"""
    WITH g AS (SELECT pair_key, least(CAST(floor(clean * 8 / 65535.0) AS BIGINT), 7) AS bin, count(*) AS n, {psnr_sql('noisy', 'clean')} AS psnr
      FROM fx_pairs GROUP BY ALL)
    SELECT k.pair_key, s.bin, coalesce(n, 0) AS count, R6(psnr) AS psnr FROM (SELECT DISTINCT pair_key FROM fx_pairs) k
    CROSS JOIN (SELECT range AS bin FROM range(8)) s LEFT JOIN g ON g.pair_key = k.pair_key AND g.bin = s.bin""")
def _(t: Tables):
    return sel(P.brightness_bin_psnr(t.pairs(), K, "noisy", "clean", 8, RANGE).select("pair_key", "bin", "count", "psnr"), ["pair_key", "bin"], 6)


IQ_CTE = windowed_ssim_cte("fx_pairs", "pair_key", "noisy", "clean", "ws") + f""",
    iq AS (SELECT pair_key, any_value(folder) AS folder, {psnr_sql('noisy', 'clean')} AS psnr, any_value(w.ssim) AS ssim, avg(noisy - clean) AS residual_mean,
      stddev_pop(noisy - clean) AS residual_std, avg(abs(noisy - clean)) AS residual_mae FROM fx_pairs JOIN ws w USING (pair_key) GROUP BY pair_key)"""


@query("image_quality", f"""WITH {IQ_CTE}
    SELECT pair_key, R6(psnr) AS psnr, R8(ssim) AS ssim, R4(residual_mean) AS residual_mean, R4(residual_std) AS residual_std, R4(residual_mae) AS residual_mae FROM iq""")
def _(t: Tables):
    return sel(P.image_quality(t.pairs(), K, "noisy", "clean", RANGE), K, 4, psnr=6, ssim=8)


BASE = ["psnr", "ssim", "residual_mean", "residual_std", "residual_mae"]


@query("pair_baseline", f"""WITH {IQ_CTE}
    SELECT folder, count(*) AS pairs, {", ".join(f"R5(avg({c})) AS {c}_mean, R5(stddev_samp({c})) AS {c}_std" for c in BASE)} FROM iq GROUP BY folder""")
def _(t: Tables):
    q = P.image_quality(t.pairs(), ["pair_key", "folder"], "noisy", "clean", RANGE)
    return sel(P.pair_baseline_summary(q, ["folder"]), ["folder"], 5)


@query("masked_quality", f"""WITH {VALID_CTE}
    SELECT pair_key, R6(avg(valid::INT)) AS valid_fraction, R6({psnr_sql('noisy', 'clean')}) AS psnr_full,
      R6(20 * log10(65535.0) - 10 * log10(avg((noisy - clean)::DOUBLE * (noisy - clean)) FILTER (valid))) AS psnr_masked,
      R4(avg(abs(noisy - clean)) FILTER (valid)) AS mae_masked, R4(avg(clean) FILTER (valid)) AS clean_mean, R4(avg(noisy) FILTER (valid)) AS noisy_mean,
      R6(avg(noisy) FILTER (valid) / avg(clean) FILTER (valid)) AS mean_ratio, R4(avg(noisy - clean) FILTER (valid)) AS residual_mean,
      R4(stddev_samp(noisy - clean) FILTER (valid)) AS residual_std, R4(quantile_cont((noisy - clean)::DOUBLE, 0.01) FILTER (valid)) AS p01,
      R4(quantile_cont((noisy - clean)::DOUBLE, 0.5) FILTER (valid)) AS p50, R4(quantile_cont((noisy - clean)::DOUBLE, 0.99) FILTER (valid)) AS p99
    FROM v GROUP BY pair_key""")
def _(t: Tables):
    return sel(P.masked_quality(masked(t), K, RANGE), K, 4, valid_fraction=6, psnr_full=6, psnr_masked=6, mean_ratio=6)


def grad_sql(c: str) -> str:
    def axis(w: str) -> str:
        return (f"CASE WHEN lag({c}) OVER {w} IS NULL THEN (lead({c}) OVER {w} - {c})::DOUBLE WHEN lead({c}) OVER {w} IS NULL "
                f"THEN ({c} - lag({c}) OVER {w})::DOUBLE ELSE (lead({c}) OVER {w} - lag({c}) OVER {w}) / 2 END")
    return f"sqrt(pow({axis('r')}, 2) + pow({axis('c')}, 2))"


PQ_CTE = windowed_ssim_cte("fx_pred", "strategy, pair_key", "value", "clean", "wv") + "," + windowed_ssim_cte("fx_pairs", "pair_key", "noisy", "clean", "wn") + f""",
    gr AS (SELECT strategy, pair_key, avg(gv) / avg(gn) AS ratio FROM (SELECT strategy, pair_key, {grad_sql('value')} AS gv, {grad_sql('noisy')} AS gn FROM fx_pred
      WINDOW r AS (PARTITION BY strategy, pair_key, y ORDER BY x), c AS (PARTITION BY strategy, pair_key, x ORDER BY y)) GROUP BY ALL),
    pq AS (SELECT strategy, pair_key, {psnr_sql('value', 'clean')} AS psnr, {psnr_sql('noisy', 'clean')} AS noisy_psnr, avg(value - clean) AS residual_mean,
      stddev_pop(value - clean) AS residual_std, avg(abs(value - clean)) AS residual_mae, stddev_pop(noisy - value) AS removed_std, avg(value - clean) AS brightness_bias
      FROM fx_pred GROUP BY ALL)"""


@query("prediction_quality", f"""WITH {PQ_CTE}
    SELECT strategy, pair_key, R6(psnr) AS psnr, R8(wv.ssim) AS ssim, R4(residual_mean) AS residual_mean, R4(residual_std) AS residual_std,
      R4(residual_mae) AS residual_mae, R6(noisy_psnr) AS noisy_psnr, R8(wn.ssim) AS noisy_ssim, R4(removed_std) AS removed_std,
      R4(brightness_bias) AS brightness_bias, R6(psnr - noisy_psnr) AS psnr_gain, R8(wv.ssim - wn.ssim) AS ssim_gain, R6(ratio) AS gradient_ratio
    FROM pq JOIN wv USING (strategy, pair_key) JOIN wn USING (pair_key) JOIN gr USING (strategy, pair_key)""")
def _(t: Tables):
    d = P.prediction_quality(t.predictions(), SK, RANGE)
    return sel(d, SK, 4, psnr=6, ssim=8, noisy_psnr=6, noisy_ssim=8, psnr_gain=6, ssim_gain=8, gradient_ratio=6)


@query("blend_strategies", f"""
    WITH s AS (SELECT folder, stddev_samp(std1) / avg(std1) AS score FROM fx_maps GROUP BY folder),
      p AS (SELECT pair_key, clean, (3 * noisy + clean) // 4 AS a, (noisy + clean) // 2 AS b, score FROM fx_pairs JOIN s USING (folder)),
      e AS (SELECT pair_key, k.blend, clean, a, b, CASE k.blend WHEN 'all_a' THEN 0.0 WHEN 'all_b' THEN 1.0 WHEN 'hard' THEN (score >= 0.1)::INT::DOUBLE
            ELSE least(greatest((score - 0.08) / 0.04::DOUBLE, 0), 1) END::DOUBLE AS alpha FROM p, (VALUES ('all_a'), ('all_b'), ('hard'), ('ramp')) k(blend)),
      v AS (SELECT *, least(greatest((1 - alpha) * a + alpha * b, 0), 65535) AS m FROM e)
    SELECT pair_key, blend, R6(any_value(alpha)) AS alpha, R4(avg(m)) AS mean, R6({psnr_sql('m', 'clean')}) AS psnr FROM v GROUP BY pair_key, blend""")
def _(t: Tables):
    from pixelstrata.operators.temporal import temporal_maps
    s = temporal_maps(t.pixels_anywhere()).groupBy("folder").agg((F.stddev_samp("std1") / F.avg("std1")).alias("score"))
    d = t.pairs().join(s, "folder").withColumn("a", F.floor((3 * F.col("noisy") + F.col("clean")) / 4)).withColumn(
        "b", F.floor((F.col("noisy") + F.col("clean")) / 2))
    sc = F.col("score")
    b = P.blend_strategies(d, "a", "b", {"all_a": P.blend_alpha("constant", sc, 0.0), "all_b": P.blend_alpha("constant", sc, 1.0),
                                         "hard": P.blend_alpha("hard", sc, 0.1), "ramp": P.blend_alpha("linear", sc, 0.08, 0.12)}, RANGE)
    q = P.psnr(b, ["pair_key", "blend"], "blended", "clean", RANGE).drop("mse", "unmatched")
    m = b.groupBy("pair_key", "blend").agg(F.max("alpha").alias("alpha"), F.avg("blended").alias("mean"))
    return sel(m.join(q, ["pair_key", "blend"]), ["pair_key", "blend"], 6, mean=4)


HIST_CTE = """
    hr AS (SELECT strategy, pair_key, (noisy - clean)::DOUBLE AS a, (value - clean)::DOUBLE AS b FROM fx_pred),
    he AS (SELECT strategy, pair_key, least(quantile_cont(a, 0.005), quantile_cont(b, 0.005), -16383.75) AS lo,
             greatest(quantile_cont(a, 0.995), quantile_cont(b, 0.995), 16383.75) AS hi FROM hr GROUP BY ALL),
    hx AS (SELECT strategy, pair_key, 0 AS s, a AS v FROM hr UNION ALL SELECT strategy, pair_key, 1, b FROM hr),
    hb AS (SELECT strategy, pair_key, least(floor((v - lo) * 64 / (hi - lo)), 63) AS bin, sum((s = 0)::INT) AS ca, sum((s = 1)::INT) AS cb
           FROM hx JOIN he USING (strategy, pair_key) WHERE v >= lo AND v <= hi GROUP BY ALL),
    hl AS (SELECT strategy, pair_key, sum(abs(ca / greatest(ta, 1) - cb / greatest(tb, 1))) AS l1 FROM
           (SELECT *, sum(ca) OVER w AS ta, sum(cb) OVER w AS tb FROM hb WINDOW w AS (PARTITION BY strategy, pair_key)) GROUP BY ALL)"""


@query("histogram_l1", f"WITH {HIST_CTE} SELECT strategy, pair_key, R8(l1) AS histogram_l1 FROM hl")
def _(t: Tables):
    r = t.predictions().select(*SK, (F.col("noisy") - F.col("clean")).alias("a"), (F.col("value") - F.col("clean")).alias("b"))
    return sel(P.histogram_l1(r, SK, "a", "b", 64, 0.25 * RANGE), SK, 8)


@query("residual_histogram", """
    SELECT folder, least(greatest(CAST(floor((noisy - clean + 16000) / 500.0) AS BIGINT), 0), 63) AS bin, count(*) AS count FROM fx_pairs GROUP BY ALL""")
def _(t: Tables):
    return P.residual_histogram(t.pairs(), ["folder"], F.col("noisy") - F.col("clean"), -16000.0, 500.0, 64)


@query("prior_fidelity", f"""WITH {HIST_CTE},
    g AS (SELECT strategy, pair_key, {psnr_sql('value', 'noisy')} AS psnr, {ssim_sql('value', 'noisy')} AS ssim,
      abs(avg(value - clean) - avg(noisy - clean)) AS me, abs(stddev_pop(value - clean) - stddev_pop(noisy - clean)) AS se,
      abs(avg(abs(value - clean)) - avg(abs(noisy - clean))) AS ae FROM fx_pred GROUP BY ALL)
    SELECT strategy, count(*) AS pairs, R6(avg(CASE WHEN isinf(psnr) THEN NULL ELSE psnr END)) AS psnr_mean, R8(avg(ssim)) AS ssim_mean,
      R4(avg(me)) AS mean_error, R4(avg(se)) AS std_error, R4(avg(ae)) AS mae_error, R8(avg(l1)) AS histogram_l1
    FROM g JOIN hl USING (strategy, pair_key) GROUP BY strategy""")
def _(t: Tables):
    from pixelstrata.functions.scalars import finite
    f = P.prior_fidelity(t.predictions(), SK, RANGE, 64, 0.25 * RANGE)
    g = f.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(finite("psnr")).alias("psnr_mean"), F.avg("ssim").alias("ssim_mean"), F.avg("mean_error").alias("mean_error"),
        F.avg("std_error").alias("std_error"), F.avg("mae_error").alias("mae_error"), F.avg("histogram_l1").alias("histogram_l1"))
    return sel(g, ["strategy"], 4, psnr_mean=6, ssim_mean=8, histogram_l1=8)


@query("prior_bin_errors", """
    WITH g AS (SELECT strategy, pair_key, least(CAST(floor(clean * 16 / 65535.0) AS BIGINT), 15) AS bin, avg(noisy - clean) AS rm, var_pop(noisy - clean) AS rv,
        avg(value - clean) AS sm, var_pop(value - clean) AS sv FROM fx_pred GROUP BY ALL)
    SELECT strategy, bin, count(*) AS pairs, R4(avg(abs(rm - sm))) AS mean_abs_error, R0(avg(abs(rv - sv))) AS var_abs_error FROM g GROUP BY strategy, bin""")
def _(t: Tables):
    p = t.predictions()
    a = P.intensity_residual_bins(p, SK, "noisy", "clean", 16, RANGE).select(*SK, "bin", F.col("mean").alias("rm"), F.col("var").alias("rv"))
    b = P.intensity_residual_bins(p, SK, "value", "clean", 16, RANGE).select(*SK, "bin", F.col("mean").alias("sm"), F.col("var").alias("sv"))
    j = a.join(b, [*SK, "bin"]).where(F.col("rm").isNotNull())
    g = j.groupBy("strategy", "bin").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.abs(F.col("rm") - F.col("sm"))).alias("mean_abs_error"),
                                         F.avg(F.abs(F.col("rv") - F.col("sv"))).alias("var_abs_error"))
    return sel(g, ["strategy", "bin"], 4, var_abs_error=0)


def shape_cte(src: str, keys: str) -> str:
    on = keys
    return f"""
    rb AS (SELECT {keys}, y, x, clean, (noisy - clean)::DOUBLE AS r FROM {src}),
    m1 AS (SELECT {keys}, count(*)::DOUBLE AS n, avg(r) AS m, stddev_samp(r) AS sd, var_pop(r) AS v, avg(clean) AS c, {_corr('clean', 'r')} AS sc,
      quantile_cont(r, [0.001, 0.01, 0.5, 0.99, 0.999]) AS q FROM rb GROUP BY ALL),
    m2 AS (SELECT {keys}, avg(pow((r - m) / greatest(sd, 1e-12), 3)) AS sk, avg(pow((r - m) / greatest(sd, 1e-12), 4)) - 3 AS ku,
      avg((abs((r - m) / greatest(sd, 1e-12)) > 2)::INT) AS tail FROM rb JOIN m1 USING ({on}) GROUP BY ALL),
    pr AS (SELECT {keys}, var_pop(p) AS rv FROM (SELECT {keys}, y, avg(r) AS p FROM rb GROUP BY ALL) GROUP BY ALL),
    pc AS (SELECT {keys}, var_pop(p) AS cv FROM (SELECT {keys}, x, avg(r) AS p FROM rb GROUP BY ALL) GROUP BY ALL),
    shape AS (SELECT * FROM m1 JOIN m2 USING ({on}) JOIN pr USING ({on}) JOIN pc USING ({on}))"""


@query("residual_shape", f"""WITH {shape_cte('fx_pairs', 'pair_key')}
    SELECT pair_key, R4(m) AS residual_mean, R4(sd) AS residual_std, R6(sc) AS signal_correlation, R6(sk) AS skewness, R6(ku) AS excess_kurtosis,
      R4(q[1]) AS q001, R4(q[2]) AS q01, R4(q[3]) AS q50, R4(q[4]) AS q99, R4(q[5]) AS q999, R4(v / c) AS fano_like, R6(tail) AS tail_share,
      R6(rv / v) AS row_share, R6(cv / v) AS column_share FROM shape""")
def _(t: Tables):
    return sel(P.residual_shape(t.pairs(), K, 2.0), K, 4, signal_correlation=6, skewness=6, excess_kurtosis=6, tail_share=6, row_share=6, column_share=6)


VARIANT_FIELDS = ["psnr_gain", "ssim", "gradient_ratio", "residual_std", "brightness_bias"]


@query("variant_summary", "SELECT variant, count(*) AS rows, " + ", ".join(
    f"R4(avg({c})) AS {c}_mean, R4(stddev_samp({c})) AS {c}_std, R4(min({c})) AS {c}_min, R4(max({c})) AS {c}_max" for c in VARIANT_FIELDS) + " FROM fx_metrics GROUP BY variant")
def _(t: Tables):
    return sel(P.variant_summary(t.metrics(), "variant", VARIANT_FIELDS), ["variant"])


def relative(a: str, b: str) -> str:
    return f"abs({a} - {b}) / greatest(0.5 * (abs({a}) + abs({b})), 1e-12)"


#: structure P is the residual of a pair, H its folded form; L has half the strength of H.
STRENGTH, TARGET = {"L": 0.5, "H": 1.0}, {"L": 0.05, "H": 0.1}
LIMITS = {"std": 0.02, "mean": 1e-6, "clip": 0.05, "psd_cosine": 0.999, "autocorr_rmse": 0.001, "psd_l1": 0.02, "signal_correlation": 0.2, "skew": 0.5, "kurtosis": 0.5, "tail": 0.01}


def decoupling_sql() -> str:
    diff = lambda k, a, b: f"coalesce(abs(max({k}) FILTER (variant = '{a}') - max({k}) FILTER (variant = '{b}')) >= {LIMITS[k]}, false)"
    one = lambda k, v: f"max({k}) FILTER (variant = '{v}')"
    cos = lambda a, b: f"(SELECT sum(x.c * y.c) / greatest(sqrt(sum(x.c * x.c)) * sqrt(sum(y.c * y.c)), 1e-12) FROM pc x JOIN pc y USING (radius) WHERE x.variant = '{a}' AND y.variant = '{b}')"
    l1 = lambda a, b: f"(SELECT avg(abs(x.c - y.c)) FROM pc x JOIN pc y USING (radius) WHERE x.variant = '{a}' AND y.variant = '{b}')"
    rm = lambda a, b: f"(SELECT sqrt(avg(pow(x.a - y.a, 2))) FROM nc x JOIN nc y USING (v, u) WHERE x.variant = '{a}' AND y.variant = '{b}')"
    checks = {
        "low_strength_matched": f"{relative(one('std', 'P-L'), one('std', 'H-L'))} <= {LIMITS['std']}", "high_strength_matched": f"{relative(one('std', 'P-H'), one('std', 'H-H'))} <= {LIMITS['std']}",
        "low_below_high": f"{one('std', 'P-L')} < {one('std', 'P-H')}", "target_std_realized": f"max(target_error) <= {LIMITS['std']}",
        "residual_mean_controlled": f"max(greatest(abs(mean_low), abs(mean_high))) <= {LIMITS['mean']}", "clipping_controlled": f"max(clip) <= {LIMITS['clip']}"}
    for n, (a, b) in {"first": ("P-L", "P-H"), "second": ("H-L", "H-H")}.items():
        checks[f"{n}_scale_only_psd"] = f"{cos(a, b)} >= {LIMITS['psd_cosine']}"
        checks[f"{n}_scale_only_autocorr"] = f"{rm(a, b)} <= {LIMITS['autocorr_rmse']}"
    for n, (a, b) in {"low": ("P-L", "H-L"), "high": ("P-H", "H-H")}.items():
        checks[f"{n}_structure_distinct"] = " OR ".join([f"{l1(a, b)} >= {LIMITS['psd_l1']}"] + [diff(k, a, b) for k in ("signal_correlation", "skew", "kurtosis", "tail")])
    listed = ", ".join(f"{{'check': '{k}', 'passed': {v}}}" for k, v in checks.items())
    return f"""
    WITH r0 AS (SELECT pair_key, y, x, clean / 65535 AS clean, (noisy - clean) / 65535 - avg((noisy - clean) / 65535) OVER (PARTITION BY pair_key) AS r FROM fx_pairs),
      r1 AS (SELECT *, abs(r) - avg(abs(r)) OVER (PARTITION BY pair_key) AS f FROM r0),
      rv AS (SELECT s.n || '-' || l.n AS variant, l.t AS target, pair_key AS frame, y, x, clean, CASE WHEN s.n = 'P' THEN r ELSE f END * l.k AS r
        FROM r1, (VALUES ('P'), ('H')) s(n), (VALUES ('L', {STRENGTH['L']}, {TARGET['L']}), ('H', {STRENGTH['H']}, {TARGET['H']})) l(n, k, t)),
      q AS (SELECT variant, frame, any_value(target) AS target, avg(r) AS m, stddev_samp(r) AS sd, stddev_pop(r) AS sp, {_corr('clean', 'r')} AS sc, avg((clean + r < 0 OR clean + r > 1)::INT) AS cl FROM rv GROUP BY ALL),
      t AS (SELECT variant, frame, avg(pow((r - m) / sp, 3)) AS sk, avg(pow((r - m) / sp, 4)) - 3 AS ku, avg((abs(r - m) > 3 * sd)::INT) AS tp FROM rv JOIN q USING (variant, frame) GROUP BY ALL),
      s AS (SELECT variant, avg(sd) AS std, max(abs(sd - target) / target) AS target_error, min(m) AS mean_low, max(m) AS mean_high, max(cl) AS clip, avg(sc) AS signal_correlation, avg(sk) AS skew, avg(ku) AS kurtosis, avg(tp) AS tail
        FROM q JOIN t USING (variant, frame) GROUP BY variant),
      {DFT.format(name='dv', k='variant', r='r', src='rv')},
      pr AS (SELECT variant, {RAD} AS radius, avg(p) AS value FROM dv WHERE {RAD} BETWEEN 1 AND 4 GROUP BY ALL), pc AS (SELECT variant, radius, value / greatest(sum(value) OVER (PARTITION BY variant), 1e-12) AS c FROM pr),
      na AS (SELECT variant, (dy.range + 4) % 8 AS v, (dx.range + 4) % 8 AS u, sum(p * cos(2 * pi() * ((v - 4) * dy.range + (u - 4) * dx.range) / 8)) AS a FROM dv, range(8) dy, range(8) dx GROUP BY ALL),
      nc AS (SELECT variant, v, u, a / max(a) FILTER (v = 4 AND u = 4) OVER (PARTITION BY variant) AS a FROM na),
      c AS (SELECT [{listed}] AS l FROM s)
    SELECT e.check AS "check", e.passed AS passed, CASE WHEN list_bool_and(list_transform(l, lambda z: z.passed)) THEN 'GO' ELSE 'STOP' END AS decision FROM (SELECT l, unnest(l) AS e FROM c)"""


@query("decoupling_checks", decoupling_sql())
def _(t: Tables):
    from pixelstrata.operators.mismatch import frame_centred, radial_share
    from pixelstrata.sources.storage import cut_lineage

    r = (F.col("noisy") - F.col("clean")) / F.lit(65535.0)
    d = frame_centred(t.pairs().select("pair_key", "folder", "frame", "y", "x", (F.col("clean") / F.lit(65535.0)).alias("clean"), r.alias("r")), K)
    d = frame_centred(d.withColumn("f", F.abs("r")), K, "f")
    kinds = F.array(*[F.struct(F.lit(f"{s}-{n}").alias("variant"), F.lit(TARGET[n]).alias("target"), (F.col("r" if s == "P" else "f") * STRENGTH[n]).alias("r")) for s in "PH" for n in "LH"])
    v = cut_lineage(d.select(*K, "folder", "frame", "y", "x", "clean", F.explode(kinds).alias("k")).select(*K, "folder", "frame", "y", "x", "clean", "k.*"))
    by, out = ["variant", *K], F.col("clean") + F.col("r")
    q = v.groupBy(*by, "target").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), corr_agg("clean", "r").alias("sc"), F.skewness("r").alias("sk"), F.kurtosis("r").alias("ku"), F.avg(((out < 0) | (out > 1)).cast("double")).alias("cl"))
    tail = v.join(q.select(*by, "m", "sd"), by).groupBy(*by).agg(F.avg((F.abs(F.col("r") - F.col("m")) > 3 * F.col("sd")).cast("double")).alias("tp"))
    s = q.join(tail, by).groupBy("variant").agg(
        F.avg("sd").alias("std"), F.max(F.abs(F.col("sd") - F.col("target")) / F.col("target")).alias("target_error"), F.min("m").alias("mean_low"), F.max("m").alias("mean_high"), F.max("cl").alias("clip"),
        F.avg("sc").alias("signal_correlation"), F.avg("sk").alias("skew"), F.avg("ku").alias("kurtosis"), F.avg("tp").alias("tail"))
    images = tile_pixels(v, ["variant", "folder", "frame"], 512, "r").select("variant", (F.col("folder") * (1 << 24) + F.col("frame")).alias("frame"), *[F.col(c).cast("int").alias(c) for c in PLACE], "r")
    blocks = cut_lineage(S.power_blocks(images, ["variant"], shape=frame_shape(images)))
    psd = radial_share(S.power_spectrum(blocks, ["variant"]), ["variant"], 4).withColumnRenamed("share", "value")
    acf = S.acf_from_power(blocks, ["variant"]).select("variant", F.col("v").alias("dy"), F.col("u").alias("dx"), F.col("acf").alias("value"))
    return P.decoupling_checks(s, psd, acf, ["P-L", "P-H", "H-L", "H-H"], LIMITS)


@query("pair_moment_gate", f"""WITH {TARGET_STD_CTE},
    b AS (SELECT pair_key, (target * 2) AS target, clean, noisy, (noisy - clean)::DOUBLE AS r FROM fx_pairs JOIN ts USING (folder)),
    g AS (SELECT pair_key, target, count(*) AS n, avg(r) AS m, stddev_pop(r) AS s, avg((noisy <= 0)::INT) AS z, avg((noisy >= 65535)::INT) AS o,
        greatest(avg((noisy <= 0)::INT) - avg((clean <= 0)::INT), 0) AS az, greatest(avg((noisy >= 65535)::INT) - avg((clean >= 65535)::INT), 0) AS ao,
        avg(least(greatest(noisy, 0), 65535)) - avg(clean) AS bs FROM b GROUP BY ALL),
    k AS (SELECT pair_key, avg(pow((r - m) / s, 3)) AS sk, avg(pow((r - m) / s, 4)) - 3 AS ku FROM b JOIN g USING (pair_key) GROUP BY pair_key),
    f AS (SELECT *, abs(s - g.target) / g.target AS se, m * sqrt(n) / g.target AS zm FROM g JOIN k USING (pair_key)),
    h AS (SELECT *, array_to_string(list_filter([CASE WHEN sk IS NULL OR ku IS NULL OR isnan(sk) OR isnan(ku) OR isinf(sk) OR isinf(ku) THEN 'NONFINITE' END, CASE WHEN ao >= 0.01 THEN 'ONE_CLIPPING' END, CASE WHEN abs(m) >= 1000 THEN 'RESIDUAL_MEAN_SAFETY' END,
      CASE WHEN abs(zm) > 2 THEN 'RESIDUAL_MEAN_Z' END, CASE WHEN se >= 0.1 THEN 'SIGMA_ERROR' END, CASE WHEN az >= 0.01 THEN 'ZERO_CLIPPING' END], lambda v: v IS NOT NULL), ';') AS fail_reasons FROM f)
    SELECT pair_key, R4(target) AS target, n AS pixels, R4(m) AS residual_mean, R4(s) AS residual_std, R6(sk) AS skewness, R6(ku) AS excess_kurtosis, R6(z) AS zero_ratio,
      R6(o) AS one_ratio, R6(az) AS added_zero_ratio, R6(ao) AS added_one_ratio, 0::DOUBLE AS noisy_round_trip, 0::DOUBLE AS residual_round_trip, R4(bs) AS brightness_shift, R6(se) AS std_relative_error, R6(zm) AS z_mean, R4(bs - m) AS clipping_contribution, fail_reasons, fail_reasons = '' AS passed FROM h""")
def _(t: Tables):
    d = with_target(t).withColumn("target", F.col("target") * 2)
    g = P.pair_moment_gate(d, K, "target", TOP, dict(std_relative_error=0.1, z_mean=2.0, residual_mean=1000.0, zero_ratio=0.01, one_ratio=0.01))
    return sel(g, K, 4, skewness=6, excess_kurtosis=6, zero_ratio=6, one_ratio=6, added_zero_ratio=6, added_one_ratio=6, std_relative_error=6, z_mean=6)


SHIFT_CTE = "fs AS (SELECT strategy, folder, frame, avg(noisy) AS i, avg(value) AS o, avg(value) - avg(noisy) AS d FROM fx_pred GROUP BY ALL)"


@query("brightness_shift", f"""WITH {SHIFT_CTE}
    SELECT strategy, folder, R4(avg(d)) AS mean_shift, R4(max(abs(d))) AS max_abs_shift, R4(max_by(i, frame) - min_by(i, frame)) AS input_drift,
      R4(max_by(o, frame) - min_by(o, frame)) AS output_drift, sum((abs(d) > 5)::INT)::BIGINT AS warning_frames, sum((abs(d) > 15)::INT)::BIGINT AS severe_frames,
      R4(quantile_cont(abs(d), 0.5)) AS median_abs_shift, R4(quantile_cont(abs(d), 0.95)) AS p95_abs_shift FROM fs GROUP BY strategy, folder""")
def _(t: Tables):
    return sel(P.brightness_shift(raw_out(t)), ["strategy", "folder"])


@query("dc_restore", f"""WITH {SHIFT_CTE}
    SELECT strategy, folder, R4(avg(value - noisy)) AS shift_before, R4(avg(value - d - noisy)) AS shift_after, R6(avg((value - d < 0)::INT)) AS below_zero,
      R6(avg((value - d > 65535)::INT)) AS over_range FROM fx_pred JOIN fs USING (strategy, folder, frame) GROUP BY strategy, folder""")
def _(t: Tables):
    return sel(P.dc_restore_summary(raw_out(t), TOP), ["strategy", "folder"], 6, shift_before=4, shift_after=4)


SOBEL = """
    s1 AS (SELECT {k}, y, x, {keep} coalesce(lag({v}) OVER c, {v}) + 2 * {v} + coalesce(lead({v}) OVER c, {v}) AS sy, coalesce(lead({v}) OVER c, {v}) - coalesce(lag({v}) OVER c, {v}) AS dy
      FROM {src} WINDOW c AS (PARTITION BY {k}, x ORDER BY y)),
    s2 AS (SELECT {k}, y, x, {keep} sqrt(pow((coalesce(lead(sy) OVER r, sy) - coalesce(lag(sy) OVER r, sy)) / 8, 2)
      + pow((coalesce(lag(dy) OVER r, dy) + 2 * dy + coalesce(lead(dy) OVER r, dy)) / 8, 2)) AS sobel FROM s1 WINDOW r AS (PARTITION BY {k}, y ORDER BY x))"""


@query("removed_residual", f"""WITH rm AS (SELECT strategy, folder, y, x, avg(noisy) AS m, avg(noisy - value) AS r, avg(abs(noisy - value)) AS a FROM fx_pred GROUP BY ALL),
    {SOBEL.format(k='strategy, folder', v='m', src='rm', keep='m, r, a,')},
    c AS (SELECT strategy, folder, {_corr('a', 'sobel')} AS gc, {_corr('r', 'm')} AS mc FROM s2 GROUP BY ALL),
    e AS (SELECT p.strategy, p.folder, frame, p.y, p.x, noisy - value - rm.r AS r FROM fx_pred p JOIN rm USING (strategy, folder, y, x)),
    e0 AS (SELECT *, r - avg(r) OVER (PARTITION BY strategy, folder, frame) AS r0 FROM e),
    re AS (SELECT strategy, folder, sqrt(avg(p * p)) AS re FROM (SELECT strategy, folder, frame, y, avg(r0) AS p FROM e0 GROUP BY ALL) GROUP BY ALL),
    ce AS (SELECT strategy, folder, sqrt(avg(p * p)) AS ce FROM (SELECT strategy, folder, frame, x, avg(r0) AS p FROM e0 GROUP BY ALL) GROUP BY ALL)
    SELECT strategy, folder, R4(avg(noisy - value)) AS removed_mean, R4(stddev_samp(noisy - value)) AS removed_std, R6(any_value(gc)) AS gradient_correlation,
      R6(any_value(mc)) AS mean_correlation, R4(any_value(re)) AS row_energy, R4(any_value(ce)) AS column_energy,
      coalesce(abs(any_value(gc)) > 0.3 OR abs(any_value(mc)) > 0.3, false) AS structure_warning
    FROM fx_pred JOIN c USING (strategy, folder) JOIN re USING (strategy, folder) JOIN ce USING (strategy, folder) GROUP BY strategy, folder""")
def _(t: Tables):
    return sel(P.removed_residual(raw_out(t), 0.3), ["strategy", "folder"], 4, gradient_correlation=6, mean_correlation=6)


@query("proxy_quality", f"""WITH px AS (SELECT f.folder, f.frame, f.y, f.x, f.dn, m.mean AS m, m.med AS md FROM fx_frames f JOIN fx_maps m USING (folder, y, x)),
    {windowed_ssim_cte('px', 'folder, frame', 'dn', 'm', 'wa')}, {windowed_ssim_cte('px', 'folder, frame', 'dn', 'md', 'wb')},
    p AS (SELECT folder, frame, {psnr_sql('dn', 'm')} AS pa, {psnr_sql('dn', 'md')} AS pb FROM px GROUP BY ALL)
    SELECT folder, R6(avg(pa)) AS psnr_mean, R8(avg(wa.ssim)) AS ssim_mean, R6(avg(pb)) AS psnr_median, R8(avg(wb.ssim)) AS ssim_median
    FROM p JOIN wa USING (folder, frame) JOIN wb USING (folder, frame) GROUP BY folder""")
def _(t: Tables):
    return sel(P.proxy_quality(t.pixels(), RANGE), ["folder"], 6, ssim_mean=8, ssim_median=8)


@query("psd_l1", """
    WITH d AS (SELECT pair_key, y, x, noisy - clean AS a, (3 * noisy + clean) // 4 - clean AS b FROM fx_pairs),
      f AS (SELECT pair_key, v.range AS v, u.range AS u, pow(sum(a * cos(2 * pi() * (v.range * y + u.range * x) / 8)), 2) + pow(sum(a * sin(2 * pi() * (v.range * y + u.range * x) / 8)), 2) AS pa,
          pow(sum(b * cos(2 * pi() * (v.range * y + u.range * x) / 8)), 2) + pow(sum(b * sin(2 * pi() * (v.range * y + u.range * x) / 8)), 2) AS pb
        FROM d, range(8) v, range(8) u GROUP BY ALL),
      r AS (SELECT pair_key, floor(sqrt(pow((v + 4) % 8 - 4, 2) + pow((u + 4) % 8 - 4, 2))) AS rad, ln(1 + avg(pa)) AS a, ln(1 + avg(pb)) AS b FROM f GROUP BY ALL),
      n AS (SELECT pair_key, a / sum(abs(a)) OVER w AS a, b / sum(abs(b)) OVER w AS b FROM r WINDOW w AS (PARTITION BY pair_key))
    SELECT pair_key, R8(avg(abs(a - b))) AS psd_l1 FROM n GROUP BY pair_key""")
def _(t: Tables):
    c, n = F.col("clean"), F.col("noisy")
    d = t.pairs().select("pair_key", "y", "x", (n - c).alias("a"), (F.floor((3 * n + c) / 4) - c).alias("b"))
    tiles = tile_pixels(d.withColumn("v", F.struct("a", "b")), ["pair_key"], 512, "v").withColumn("frame", F.lit(0))
    tiles = tiles.select("pair_key", "frame", *[F.col(c).cast("int").alias(c) for c in PLACE], F.col("v.a").cast("array<double>").alias("a"), F.col("v.b").cast("array<double>").alias("b"))
    shape = frame_shape(t.tiles(), None)
    sp = lambda v: S.power_spectrum(S.power_blocks(tiles, K, v, shape=shape), K)
    return sel(S.psd_l1(sp("a"), sp("b"), K), K, 8)
