"""Stencil, correlation and spectrum queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pixelstrata.functions.scalars import big, corr_agg, dbl, rnd, safe_div
from pixelstrata.operators import spatial as A
from pixelstrata.operators import spectral as S
from pixelstrata.operators import tiles as L
from pixelstrata.operators.frames import explode_tiles
from pixelstrata.operators.temporal import frame_subsets, temporal_residual
from pixelstrata.operators.tiles import frame_shape, tile_residual
from pixelstrata.plans.fourier_sql import BANDS_SQL, DFT, EDGES, FREQ, HANN, RAD
from pixelstrata.plans.queries_pairs import SOBEL, grad_sql
from pixelstrata.plans.queries_temporal import HP_CTE, SUBSET_CTE, _corr, raw_out, sel
from pixelstrata.plans.registry import query
from pixelstrata.plans.views import Tables

FR = ["folder", "frame"]


@query("temporal_residual", "SELECT folder, frame, y, x, R4(r) AS residual FROM fx_resid0")
def _(t: Tables):
    return temporal_residual(t.pixels()).select("folder", "frame", "y", "x", rnd("r", 4).alias("residual"))


@query("lag1_spatial_corr", f"""
    WITH n AS (SELECT folder, r, lead(r) OVER h AS h, lead(r) OVER v AS v, d, a FROM (
        SELECT folder, frame, y, x, r, lead(r1) OVER (PARTITION BY folder, frame, x ORDER BY y) AS d, lead(r0) OVER (PARTITION BY folder, frame, x ORDER BY y) AS a FROM (
          SELECT *, lead(r) OVER (PARTITION BY folder, frame, y ORDER BY x) AS r1, lag(r) OVER (PARTITION BY folder, frame, y ORDER BY x) AS r0 FROM fx_resid0))
        WINDOW h AS (PARTITION BY folder, frame, y ORDER BY x), v AS (PARTITION BY folder, frame, x ORDER BY y))
    SELECT folder, {", ".join(f"R6(covar_pop(r, {c}) / (stddev_pop(r) FILTER ({c} IS NOT NULL) * stddev_pop({c}))) AS {n}" for c, n in (('h', 'horizontal'), ('v', 'vertical'), ('d', 'diagonal'), ('a', 'anti_diagonal')))}
    FROM n GROUP BY folder""")
def _(t: Tables):
    return sel(A.lag1_correlation(temporal_residual(t.pixels()), FR, "r", ["folder"]), ["folder"], 6)


@query("neighbor_join", """
    SELECT a.folder, o.dy::BIGINT AS dy, o.dx::BIGINT AS dx, count(*) AS products, R2(sum(a.r * b.r) / count(*)) AS covariance
    FROM fx_resid0 a CROSS JOIN (SELECT u.range AS dy, v.range - 2 AS dx FROM range(3) u, range(5) v) o
    JOIN fx_resid0 b ON a.folder = b.folder AND a.frame = b.frame AND b.y = a.y + o.dy AND b.x = a.x + o.dx GROUP BY ALL""")
def _(t: Tables):
    tiles = t.tiles()
    shape = frame_shape(tiles)
    p = L.lag_products(tile_residual(tiles, shape=shape), ["folder"], "r", 2, shape)
    return sel(p.select("folder", "dy", "dx", F.col("n").alias("products"), (F.col("total") / F.col("n")).alias("covariance")), ["folder", "dy", "dx"], 2)


COV_SQL = """
    WITH c AS (SELECT a.folder, o.dy, o.dx, sum(a.r * b.r) / count(*) AS cov
      FROM fx_resid0 a CROSS JOIN (SELECT u.range - {l} AS dy, v.range - {l} AS dx FROM range({n}) u, range({n}) v) o
      JOIN fx_resid0 b ON a.folder = b.folder AND a.frame = b.frame AND b.y = a.y + o.dy AND b.x = a.x + o.dx GROUP BY ALL),
    acf AS (SELECT folder, dy, dx, cov, cov / max(cov) FILTER (dy = 0 AND dx = 0) OVER (PARTITION BY folder) AS acf FROM c)"""


def power_blocks(t: Tables, demean: bool = True, **given):
    tiles = t.tiles()
    shape = frame_shape(tiles)
    return S.power_blocks(tile_residual(tiles, demean, shape=shape), ["folder"], shape=shape, **given)


def acov(t: Tables, lag: int):
    return S.autocovariance(power_blocks(t, pad=2), ["folder"], lag)


@query("autocovariance_2d", COV_SQL.format(l=2, n=5) + "SELECT folder, dy, dx, R2(cov) AS covariance, R6(acf) AS acf FROM acf")
def _(t: Tables):
    return sel(acov(t, 2), ["folder", "dy", "dx"], 6, covariance=2)


@query("autocovariance_summary", COV_SQL.format(l=3, n=7) + """,
    p AS (SELECT folder, CAST(round_even(sqrt(dy * dy + dx * dx), 0) AS BIGINT) AS radius, avg(acf) AS value FROM acf GROUP BY ALL),
    l AS (SELECT folder, min(radius) FILTER (radius > 0 AND abs(value) < 0.36787944117144233) AS a, min(radius) FILTER (radius > 0 AND abs(value) < 0.1) AS b
          FROM p WHERE radius <= 3 GROUP BY folder)
    SELECT folder, R6(max(acf) FILTER (dy = 0 AND dx = 1)) AS horizontal_lag1, R6(max(acf) FILTER (dy = 1 AND dx = 0)) AS vertical_lag1,
      R6(avg(acf) FILTER (abs(dy) = 1 AND abs(dx) = 1)) AS diagonal_lag1, R6(min(acf)) AS min_acf, R6(max(acf) FILTER (dy <> 0 OR dx <> 0)) AS max_nonzero_acf,
      bool_or(acf > 0.01 AND (dy <> 0 OR dx <> 0)) AS positive_lobe, bool_or(acf < -0.01) AS negative_lobe,
      R6(abs(max(acf) FILTER (dy = 0 AND dx = 1) - max(acf) FILTER (dy = 1 AND dx = 0))) AS anisotropy, any_value(a) AS length_1e, any_value(b) AS length_0p1
    FROM acf JOIN l USING (folder) GROUP BY folder""")
def _(t: Tables):
    return sel(S.autocovariance_summary(acov(t, 3), ["folder"], 3), ["folder"], 6)


@query("gaussian_highpass", f"""WITH {HP_CTE},
    b1 AS (SELECT folder, i AS y, x, sum(w * mean) AS v FROM fx_maps JOIN refl ON y = j GROUP BY ALL),
    b2 AS (SELECT folder, y, i AS x, sum(w * v) AS low FROM b1 JOIN refl ON x = j GROUP BY ALL)
    SELECT folder, y, x, R4(mean - low) AS highpass FROM fx_maps JOIN b2 USING (folder, y, x)""")
def _(t: Tables):
    tiles, kernel = t.tiles(), A.gaussian_kernel(1.0)
    hp = L.stencil(L.tile_moments(tiles, ["folder"]), ["folder"], "mean", max(k for k, _ in kernel), frame_shape(tiles), L.blur(kernel), ["hp"], "reflect")
    return sel(explode_tiles(hp, value="hp").select("folder", "y", "x", F.col("hp").alias("highpass")), ["folder", "y", "x"])


@query("box_filter", """
    WITH b AS (SELECT a.folder, a.frame, a.y, a.x, count(*) AS n, avg(b.dn) AS m, stddev_pop(b.dn) AS s FROM fx_frames a
      JOIN fx_frames b ON a.folder = b.folder AND a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
    SELECT folder, frame, y, x, R4(m) AS local_mean, R3(s) AS local_std FROM b WHERE n = 9""")
def _(t: Tables):
    tiles = t.tiles()
    b = L.stencil(tiles, FR, "dn", 1, frame_shape(tiles), L.box(1), ["local_mean", "local_std"], "nan")
    both = F.zip_with("local_mean", "local_std", lambda m, s: F.struct(m.alias("local_mean"), s.alias("local_std")))
    b = explode_tiles(b.withColumn("b", both).drop("local_mean", "local_std"), value="b").where("b.local_mean is not null")
    return sel(b.select(*FR, "y", "x", "b.*"), ["folder", "frame", "y", "x"], 4, local_std=3)


LAP_CTE = """
    lp AS (SELECT folder, frame, coalesce(lag(dn) OVER r, dn) + coalesce(lead(dn) OVER r, dn) + coalesce(lag(dn) OVER c, dn) + coalesce(lead(dn) OVER c, dn) - 4 * dn AS lap
      FROM fx_frames WINDOW r AS (PARTITION BY folder, frame, y ORDER BY x), c AS (PARTITION BY folder, frame, x ORDER BY y))"""


@query("laplacian_variance", f"WITH {LAP_CTE} SELECT folder, frame, R1(var_samp(lap)) AS laplacian_variance FROM lp GROUP BY folder, frame")
def _(t: Tables):
    return sel(A.laplacian(t.pixels(), FR, "dn").groupBy(*FR).agg(F.var_samp("lap").alias("laplacian_variance")), FR, 1)


@query("gradient_central", f"""
    SELECT folder, frame, R4(avg(g)) AS gradient_mean, R1(avg(g * g)) AS gradient_energy FROM (SELECT folder, frame, {grad_sql('dn')} AS g FROM fx_frames
      WINDOW r AS (PARTITION BY folder, frame, y ORDER BY x), c AS (PARTITION BY folder, frame, x ORDER BY y)) GROUP BY folder, frame""")
def _(t: Tables):
    tiles = t.tiles()
    sums = lambda w: {"n": np.array([w[1:-1, 1:-1].size]), "s": (g := L.central(w)["grad"]).sum(keepdims=True), "ss": (g * g).sum(keepdims=True)}
    g = L.stencil(tiles, FR, "dn", 1, frame_shape(tiles), sums, ["n", "s", "ss"], "nan")
    total = lambda c: F.sum(F.get(c, F.lit(0)))
    return sel(g.groupBy(*FR).agg((total("s") / total("n")).alias("gradient_mean"), (total("ss") / total("n")).alias("gradient_energy")), FR, 4, gradient_energy=1)


FWD_CTE = """
    fw AS (SELECT folder, frame, lead(dn) OVER r - dn AS dx, lead(dn) OVER c - dn AS dy FROM fx_frames
      WINDOW r AS (PARTITION BY folder, frame, y ORDER BY x), c AS (PARTITION BY folder, frame, x ORDER BY y))"""


@query("gradient_forward", f"""WITH {FWD_CTE}
    SELECT folder, frame, R4((avg(abs(dx)) + avg(abs(dy))) / 2) AS mean_abs, R1((avg(dx::DOUBLE * dx) + avg(dy::DOUBLE * dy)) / 2) AS energy FROM fw GROUP BY folder, frame""")
def _(t: Tables):
    d = A.forward_differences(t.pixels(), FR, "dn").groupBy(*FR).agg(
        ((F.avg(F.abs("dx")) + F.avg(F.abs("dy"))) / 2).alias("mean_abs"), ((F.avg(F.col("dx") ** 2) + F.avg(F.col("dy") ** 2)) / 2).alias("energy"))
    return sel(d, FR, 4, energy=1)


@query("gradient_sobel", f"WITH {SOBEL.format(k='folder, frame', v='dn', src='fx_frames', keep='')} SELECT folder, frame, R4(avg(sobel)) AS sobel_mean FROM s2 GROUP BY folder, frame")
def _(t: Tables):
    return sel(A.sobel(t.pixels(), FR, "dn").groupBy(*FR).agg(F.avg("sobel").alias("sobel_mean")), FR)


@query("frame_summary_wide", f"""WITH {LAP_CTE}, {FWD_CTE}, {HP_CTE},
    b1 AS (SELECT folder, frame, i AS y, x, sum(w * dn) AS v FROM fx_frames JOIN refl ON y = j GROUP BY ALL),
    b2 AS (SELECT folder, frame, y, i AS x, sum(w * v) AS low FROM b1 JOIN refl ON x = j GROUP BY ALL),
    hf AS (SELECT folder, frame, avg(pow(dn - low, 2)) AS hf FROM fx_frames JOIN b2 USING (folder, frame, y, x) GROUP BY ALL),
    rw AS (SELECT folder, frame, stddev_samp(m) AS rv FROM (SELECT folder, frame, y, avg(dn) AS m FROM fx_frames GROUP BY ALL) GROUP BY ALL),
    cw AS (SELECT folder, frame, stddev_samp(m) AS cv FROM (SELECT folder, frame, x, avg(dn) AS m FROM fx_frames GROUP BY ALL) GROUP BY ALL),
    md AS (SELECT folder, frame, median(dn::DOUBLE) AS md FROM fx_frames GROUP BY ALL),
    ma AS (SELECT folder, frame, greatest(1.4826 * median(abs(dn - md)), 1) AS rs, any_value(md) AS md FROM fx_frames JOIN md USING (folder, frame) GROUP BY ALL),
    base AS (SELECT folder, frame, min(dn) AS mn, max(dn) AS mx, avg(dn) AS me, stddev_samp(dn) AS sd, quantile_cont(dn::DOUBLE, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q,
      count(DISTINCT dn) AS uq, avg((dn <= md - 8 * rs OR dn >= md + 8 * rs)::INT) AS bad FROM fx_frames JOIN ma USING (folder, frame) GROUP BY ALL),
    l AS (SELECT folder, frame, var_samp(lap) AS lv FROM lp GROUP BY ALL),
    g AS (SELECT folder, frame, (avg(dx::DOUBLE * dx) + avg(dy::DOUBLE * dy)) / 2 AS ge FROM fw GROUP BY ALL)
    SELECT folder, frame, mx - mn AS dynamic_range, R4(me) AS mean, R4(sd) AS std, R4(q[1]) AS p5, R4(q[2]) AS p25, R4(q[3]) AS p50, R4(q[4]) AS p75, R4(q[5]) AS p95, uq AS unique_values,
      R1(lv) AS laplacian_variance, R1(ge) AS gradient_energy, R1(hf) AS high_frequency_energy, R4(rv) AS row_mean_variation, R4(cv) AS column_mean_variation, R6(bad) AS bad_pixel_ratio
    FROM base JOIN l USING (folder, frame) JOIN g USING (folder, frame) JOIN hf USING (folder, frame) JOIN rw USING (folder, frame) JOIN cw USING (folder, frame)""")
def _(t: Tables):
    px = t.pixels()
    med = px.groupBy(*FR).agg(F.percentile("dn", 0.5).alias("_md"))
    d = px.join(med, FR).withColumn("_dev", F.abs(F.col("dn") - F.col("_md")))
    mad = d.groupBy(*FR).agg(F.greatest(1.4826 * F.percentile("_dev", 0.5), F.lit(1.0)).alias("_rs"))
    far = (F.col("dn") <= F.col("_md") - 8 * F.col("_rs")) | (F.col("dn") >= F.col("_md") + 8 * F.col("_rs"))
    base = d.join(mad, FR).groupBy(*FR).agg(
        (F.max("dn") - F.min("dn")).alias("dynamic_range"), F.avg("dn").alias("mean"), F.stddev_samp("dn").alias("std"),
        F.percentile("dn", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("_q"),
        F.count_distinct("dn").alias("unique_values"), F.avg(far.cast("double")).alias("bad_pixel_ratio"))
    base = base.select("*", *[F.element_at("_q", i + 1).alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))]).drop("_q")
    # all stencils share one pass: the line windows only append columns to the same rows
    st = A.forward_differences(A.laplacian(px, FR, "dn"), FR, "dn").groupBy(*FR).agg(
        F.var_samp("lap").alias("laplacian_variance"), ((F.avg(F.col("dx") ** 2) + F.avg(F.col("dy") ** 2)) / 2).alias("gradient_energy"))
    hf = A.gaussian_highpass(px, FR, "dn", 1.0).groupBy(*FR).agg(F.avg(F.col("hp") ** 2).alias("high_frequency_energy"))
    prof = lambda axis, n: px.groupBy(*FR, axis).agg(F.avg("dn").alias("m")).groupBy(*FR).agg(F.stddev_samp("m").alias(n))
    out = base.join(st, FR).join(hf, FR).join(prof("y", "row_mean_variation"), FR).join(prof("x", "column_mean_variation"), FR)
    return sel(out, FR, 4, laplacian_variance=1, gradient_energy=1, high_frequency_energy=1, bad_pixel_ratio=6)


def regions(t: Tables):
    """Flat / low / medium / high gradient regions of the raw mean map, per (strategy, folder)."""
    from pixelstrata.functions.ordering import add_bounded_quantiles
    key = ["strategy", "folder"]
    m = raw_out(t).groupBy(*key, "y", "x").agg(F.avg("raw").alias("m"))
    m = add_bounded_quantiles(A.sobel(m, key, "m"), key, "sobel", {"q25": 0.25, "q50": 0.5, "q90": 0.9})
    g = F.col("sobel")
    return m.select(*key, "y", "x", "m", F.when(g <= F.col("q25"), "flat").when(g <= F.col("q50"), "low").when(g <= F.col("q90"), "medium").otherwise("high").alias("region"))


REGION_CTE = f"""
    rm AS (SELECT strategy, folder, y, x, avg(noisy) AS m FROM fx_pred GROUP BY ALL),
    {SOBEL.format(k='strategy, folder', v='m', src='rm', keep='m,')},
    rq AS (SELECT strategy, folder, quantile_cont(sobel, 0.25) AS q25, quantile_cont(sobel, 0.5) AS q50, quantile_cont(sobel, 0.9) AS q90 FROM s2 GROUP BY ALL),
    reg AS (SELECT strategy, folder, y, x, m, CASE WHEN sobel <= q25 THEN 'flat' WHEN sobel <= q50 THEN 'low' WHEN sobel <= q90 THEN 'medium' ELSE 'high' END AS region
            FROM s2 JOIN rq USING (strategy, folder)),
    gs AS (SELECT strategy, folder, frame, y, x, noisy, value, gn, gv FROM (
        SELECT *, sqrt(pow((coalesce(lead(sn) OVER r, sn) - coalesce(lag(sn) OVER r, sn)) / 8, 2) + pow((coalesce(lag(en) OVER r, en) + 2 * en + coalesce(lead(en) OVER r, en)) / 8, 2)) AS gn,
          sqrt(pow((coalesce(lead(sv) OVER r, sv) - coalesce(lag(sv) OVER r, sv)) / 8, 2) + pow((coalesce(lag(ev) OVER r, ev) + 2 * ev + coalesce(lead(ev) OVER r, ev)) / 8, 2)) AS gv
        FROM (SELECT *, coalesce(lag(noisy) OVER c, noisy) + 2 * noisy + coalesce(lead(noisy) OVER c, noisy) AS sn, coalesce(lead(noisy) OVER c, noisy) - coalesce(lag(noisy) OVER c, noisy) AS en,
            coalesce(lag(value) OVER c, value) + 2 * value + coalesce(lead(value) OVER c, value) AS sv, coalesce(lead(value) OVER c, value) - coalesce(lag(value) OVER c, value) AS ev
          FROM fx_pred WINDOW c AS (PARTITION BY strategy, folder, frame, x ORDER BY y)) WINDOW r AS (PARTITION BY strategy, folder, frame, y ORDER BY x)))"""


def with_gradients(t: Tables):
    k = ["strategy", "folder", "frame"]
    g = A.sobel(raw_out(t), k, "raw").withColumnRenamed("sobel", "g_raw")
    return A.sobel(g, k, "value").withColumnRenamed("sobel", "g_out")


@query("gradient_regions", f"""WITH {REGION_CTE},
    pm AS (SELECT strategy, folder, region, y, x, any_value(m) AS m, var_samp(noisy) AS vr, var_samp(value) AS vo, avg(noisy - value) AS rmv FROM gs JOIN reg USING (strategy, folder, y, x) GROUP BY ALL),
    a AS (SELECT strategy, folder, region, count(*) AS pixel_count, 1 - avg(vo) / avg(vr) AS vred, {_corr('rmv', 'm')} AS rc FROM pm GROUP BY ALL),
    lv AS (SELECT strategy, folder, region, avg(lo) / avg(lr) AS ratio FROM (SELECT strategy, folder, region, frame, var_samp(noisy) AS lr, var_samp(value) AS lo FROM gs JOIN reg USING (strategy, folder, y, x) GROUP BY ALL) GROUP BY ALL),
    b AS (SELECT strategy, folder, region, avg(abs(noisy - value)) AS mae, avg(gv) / avg(gn) AS gr FROM gs JOIN reg USING (strategy, folder, y, x) GROUP BY ALL)
    SELECT strategy, folder, region, pixel_count, R6(vred) AS variance_reduction, R6(rc) AS removed_correlation, R6(ratio) AS local_variance_ratio, R4(mae) AS mae, R6(gr) AS gradient_ratio
    FROM a JOIN lv USING (strategy, folder, region) JOIN b USING (strategy, folder, region)""")
def _(t: Tables):
    key = ["strategy", "folder", "region"]
    j = with_gradients(t).join(regions(t), ["strategy", "folder", "y", "x"])
    pm = j.groupBy(*key, "y", "x").agg(F.first("m").alias("m"), F.var_samp("raw").alias("vr"), F.var_samp("value").alias("vo"), F.avg(F.col("raw") - F.col("value")).alias("rm"))
    a = pm.groupBy(*key).agg(F.count(F.lit(1)).alias("pixel_count"), (1 - safe_div(F.avg("vo"), F.avg("vr"))).alias("variance_reduction"), corr_agg("rm", "m").alias("removed_correlation"))
    lv = j.groupBy(*key, "frame").agg(F.var_samp("raw").alias("r"), F.var_samp("value").alias("o")).groupBy(*key).agg(safe_div(F.avg("o"), F.avg("r")).alias("local_variance_ratio"))
    b = j.groupBy(*key).agg(F.avg(F.abs(F.col("raw") - F.col("value"))).alias("mae"), safe_div(F.avg("g_out"), F.avg("g_raw")).alias("gradient_ratio"))
    return sel(a.join(lv, key).join(b, key), key, 6, mae=4)


@query("gradient_retention", f"""WITH {REGION_CTE},
    f AS (SELECT strategy, folder, frame, avg(gv) AS ov, avg(gn) AS rv, avg(gv) FILTER (region = 'high') / avg(gn) FILTER (region = 'high') AS hr, avg((gv >= q90)::INT) AS ed
          FROM gs JOIN reg USING (strategy, folder, y, x) JOIN rq USING (strategy, folder) GROUP BY ALL),
    v AS (SELECT strategy, folder, avg(vo) FILTER (region = 'high') / avg(vr) FILTER (region = 'high') AS hv, avg(vo) FILTER (region = 'flat') / avg(vr) FILTER (region = 'flat') AS fv
          FROM (SELECT strategy, folder, region, y, x, var_samp(noisy) AS vr, var_samp(value) AS vo FROM gs JOIN reg USING (strategy, folder, y, x) GROUP BY ALL) GROUP BY ALL)
    SELECT strategy, folder, R6(avg(ov) / avg(rv)) AS gradient_ratio, R6(avg(ed)) AS edge_density, R6(avg(hr)) AS high_gradient_retention, R6(any_value(hv)) AS high_variance_ratio, R6(any_value(fv)) AS flat_variance_ratio
    FROM f JOIN v USING (strategy, folder) GROUP BY strategy, folder""")
def _(t: Tables):
    from pixelstrata.functions.ordering import bounded_quantiles
    key = ["strategy", "folder"]
    m = A.sobel(raw_out(t).groupBy(*key, "y", "x").agg(F.avg("raw").alias("m")), key, "m")
    q = bounded_quantiles(m, key, "sobel", {"q90": 0.9})
    j = with_gradients(t).join(regions(t), [*key, "y", "x"]).join(q, key)
    high, flat = F.col("region") == "high", F.col("region") == "flat"
    on = lambda c, e: F.avg(F.when(c, F.col(e)))
    f = j.groupBy(*key, "frame").agg(
        F.avg("g_out").alias("o"), F.avg("g_raw").alias("r"), safe_div(on(high, "g_out"), on(high, "g_raw")).alias("h"), F.avg((F.col("g_out") >= F.col("q90")).cast("double")).alias("e"))
    f = f.groupBy(*key).agg(safe_div(F.avg("o"), F.avg("r")).alias("gradient_ratio"), F.avg("e").alias("edge_density"), F.avg("h").alias("high_gradient_retention"))
    v = j.groupBy(*key, "region", "y", "x").agg(F.var_samp("raw").alias("vr"), F.var_samp("value").alias("vo"))
    high, flat = F.col("region") == "high", F.col("region") == "flat"
    v = v.groupBy(*key).agg(safe_div(on(high, "vo"), on(high, "vr")).alias("high_variance_ratio"), safe_div(on(flat, "vo"), on(flat, "vr")).alias("flat_variance_ratio"))
    return sel(f.join(v, key), key, 6)


# -- spectra -----------------------------------------------------------------------
# Oracle: direct 8 x 8 Fourier sums; v, u shifted so that zero frequency is at (4, 4).
PS_CTE = DFT.format(name="ps", k="folder", r="r", src="fx_resid0")


def spectrum(t: Tables):
    return S.power_spectrum(power_blocks(t), ["folder"])


@query("power_spectrum", f"WITH {PS_CTE} SELECT folder, v, u, R3(p / 1e6) AS power_m FROM ps")
def _(t: Tables):
    return spectrum(t).select("folder", "v", "u", rnd(F.col("power") / 1e6, 3).alias("power_m"))




@query("windowed_nps", f"""WITH hw AS (SELECT folder, frame, y, x, r * {HANN} AS r FROM fx_resid0), {DFT.format(name='ps', k='folder', r='r', src='hw')},
    nw AS (SELECT sum(pow({HANN}, 2)) AS norm FROM (SELECT a.range AS y, b.range AS x FROM range(8) a, range(8) b))
    SELECT folder, v, u, R3(p / norm / 1e4) AS nps_e4 FROM ps, nw""")
def _(t: Tables):
    p = S.power_spectrum(power_blocks(t, hann=True), ["folder"])
    return p.select("folder", "v", "u", rnd(F.col("power") / 1e4, 3).alias("nps_e4"))


@query("radial_average", f"""WITH {PS_CTE}, r AS (SELECT folder, {RAD} AS radius, avg(p) AS value FROM ps GROUP BY ALL)
    SELECT folder, radius, R3(value / 1e6) AS value_m, R8(value / sum(abs(value)) OVER (PARTITION BY folder)) AS share FROM r""")
def _(t: Tables):
    r = S.radial_average(spectrum(t), ["folder"], "power")
    return r.select("folder", "radius", rnd(F.col("value") / 1e6, 3).alias("value_m"), rnd("share", 8).alias("share"))



@query("band_fractions", f"WITH {DFT.format(name='ps', k='folder', r='r', src='fx_resid')}, b AS (SELECT folder, p, {FREQ} AS f FROM ps) SELECT folder, {BANDS_SQL} FROM b GROUP BY folder")
def _(t: Tables):
    p = S.power_spectrum(power_blocks(t, demean=False), ["folder"])
    return sel(S.band_fractions(p, ["folder"], EDGES), ["folder"], 8)


ACF_CTE = PS_CTE + """,
    ac AS (SELECT folder, (dy.range + 4) % 8 AS v, (dx.range + 4) % 8 AS u, sum(p * cos(2 * pi() * ((v - 4) * dy.range + (u - 4) * dx.range) / 8)) / 64 AS a
      FROM ps, range(8) dy, range(8) dx GROUP BY ALL),
    acf AS (SELECT folder, v, u, a / max(a) FILTER (v = 4 AND u = 4) OVER (PARTITION BY folder) AS acf FROM ac)"""


@query("acf_from_psd", f"WITH {ACF_CTE} SELECT folder, v, u, R8(acf) AS acf FROM acf")
def _(t: Tables):
    return S.acf_from_power(power_blocks(t), ["folder"]).select("folder", "v", "u", rnd("acf", 8).alias("acf"))


@query("correlation_length", f"""WITH {ACF_CTE}, r AS (SELECT folder, {RAD} AS radius, avg(acf) AS value FROM acf WHERE {RAD} <= 4 GROUP BY ALL),
    m AS (SELECT folder, min(radius) FILTER (radius >= 1 AND value <= 0.36787944117144233) AS a, min(radius) FILTER (radius >= 1 AND value <= -0.017) AS b FROM r GROUP BY folder)
    SELECT folder, coalesce(a, 5) AS length_1e, coalesce(b, 5) AS length_negative, a IS NULL AS length_1e_censored, b IS NULL AS length_negative_censored FROM m""")
def _(t: Tables):
    r = S.radial_average(S.acf_from_power(power_blocks(t), ["folder"]), ["folder"], "acf", 4)
    return S.correlation_length(r, ["folder"], {"length_1e": 0.36787944117144233, "length_negative": -0.017}, 4)


@query("directional_psd", f"""WITH {PS_CTE},
    d AS (SELECT folder, 'horizontal' AS direction, u AS idx, p FROM ps WHERE abs(v - 4) <= 1 UNION ALL SELECT folder, 'vertical', v, p FROM ps WHERE abs(u - 4) <= 1
          UNION ALL SELECT folder, 'diagonal', v, p FROM ps WHERE u = v),
    g AS (SELECT folder, direction, idx, avg(p) AS value FROM d GROUP BY ALL)
    SELECT folder, direction, idx, R3(value / 1e6) AS value_m, R8(value / sum(value) OVER (PARTITION BY folder, direction)) AS normalized FROM g""")
def _(t: Tables):
    d = S.directional_psd(spectrum(t), ["folder"], 1)
    return d.select("folder", "direction", "idx", rnd(F.col("value") / 1e6, 3).alias("value_m"), rnd("normalized", 8).alias("normalized"))


@query("psd_flatness", f"WITH {PS_CTE} SELECT folder, R8(exp(avg(ln(p))) / avg(p)) AS flatness FROM ps WHERE NOT (v = 4 AND u = 4) GROUP BY folder")
def _(t: Tables):
    return sel(S.psd_flatness(spectrum(t), ["folder"]), ["folder"], 8)


@query("spectrum_repeatability", f"""WITH {SUBSET_CTE},
    sr AS (SELECT folder, subset, frame, y, x, r FROM fx_resid0 JOIN tag USING (folder, frame) WHERE subset IN ('all', 'odd', 'even', 'first_half', 'second_half')),
    {DFT.format(name='ps', k='folder, subset', r='r', src='sr')},
    c AS (SELECT a.folder, a.subset, {_corr('a.p', 'b.p')} AS c FROM ps a JOIN ps b ON a.folder = b.folder AND b.subset = 'all' AND a.v = b.v AND a.u = b.u GROUP BY ALL),
    b AS (SELECT folder, subset, sum(CASE WHEN f >= {EDGES[0]} AND f < {EDGES[1]} THEN p ELSE 0 END) / sum(p) AS l, sum(CASE WHEN f >= {EDGES[1]} AND f < {EDGES[2]} THEN p ELSE 0 END) / sum(p) AS m,
      sum(CASE WHEN f >= {EDGES[2]} THEN p ELSE 0 END) / sum(p) AS h FROM (SELECT *, {FREQ} AS f FROM ps) GROUP BY ALL)
    SELECT folder, c.subset, R6(c.c) AS spectrum_correlation, R8(b.l - f.l) AS low_fraction_difference, R8(b.m - f.m) AS mid_fraction_difference, R8(b.h - f.h) AS high_fraction_difference
    FROM c JOIN b USING (folder, subset) JOIN (SELECT * FROM b WHERE subset = 'all') f USING (folder)""")
def _(t: Tables):
    tiles = t.tiles()
    shape = frame_shape(tiles)
    r = frame_subsets(tile_residual(tiles, shape=shape), ["all", "odd", "even", "first_half", "second_half"], block=8)
    p = S.power_spectrum(S.power_blocks(r, ["folder", "subset"], shape=shape), ["folder", "subset"])
    return sel(S.spectrum_repeatability(p, ["folder"], EDGES), ["folder", "subset"], 8, spectrum_correlation=6)


TRANSFORMS = ["identity", "flip_x", "flip_y", "rot90", "rot180", "rot270", "transpose"]
ALIGN_SQL = {"identity": ("y", "x"), "flip_x": ("y", "7 - x"), "flip_y": ("7 - y", "x"), "rot90": ("7 - x", "y"), "rot180": ("7 - y", "7 - x"), "rot270": ("x", "7 - y"), "transpose": ("x", "y")}


@query("map_alignment", f"""WITH dm AS (SELECT y, x, floor(mean) AS d FROM fx_maps WHERE folder = 0),
    tf AS ({" UNION ALL ".join(f"SELECT '{n}' AS transform, {a} AS y, {b} AS x, d FROM dm" for n, (a, b) in ALIGN_SQL.items())}),
    j AS (SELECT folder, transform, y, x, d, med FROM fx_maps JOIN tf USING (y, x)),
    px AS (SELECT folder, transform, {_corr('d', 'med')} AS c FROM j GROUP BY ALL),
    rw AS (SELECT folder, transform, {_corr('d', 'm')} AS c FROM (SELECT folder, transform, y, avg(d) AS d, avg(med) AS m FROM j GROUP BY ALL) GROUP BY ALL),
    cl AS (SELECT folder, transform, {_corr('d', 'm')} AS c FROM (SELECT folder, transform, x, avg(d) AS d, avg(med) AS m FROM j GROUP BY ALL) GROUP BY ALL),
    th AS (SELECT folder, transform, quantile_cont(d, 0.9) AS qd, quantile_cont(med, 0.9) AS qm FROM j GROUP BY ALL),
    jc AS (SELECT folder, transform, sum((d >= qd AND med >= qm)::INT) / sum((d >= qd OR med >= qm)::INT) AS jac FROM j JOIN th USING (folder, transform) GROUP BY ALL)
    SELECT folder, transform, R6(px.c) AS pixel_correlation, R6(rw.c) AS row_correlation, R6(cl.c) AS column_correlation, R6(jac) AS outlier_jaccard,
      row_number() OVER (PARTITION BY folder ORDER BY round(px.c, 9) DESC, transform) = 1 AS best
    FROM px JOIN rw USING (folder, transform) JOIN cl USING (folder, transform) JOIN jc USING (folder, transform)""")
def _(t: Tables):
    from pixelstrata.operators.curation import map_alignment
    m = t.pixels_anywhere().groupBy("folder", "y", "x").agg(F.avg("dn").alias("mean"), F.percentile("dn", 0.5).alias("median"))
    dark = m.where("folder = 0").select("y", "x", F.floor("mean").cast("double").alias("dark"))
    return sel(map_alignment(m.select("folder", "y", "x", "median"), dark, 8), ["folder", "transform"], 6)


@query("map_comparison", """
    WITH dm AS (SELECT y, x, CAST(floor(mean) AS BIGINT) AS d FROM fx_maps WHERE folder = 0), j AS (SELECT folder, dn - d AS r, dn, d FROM fx_frames JOIN dm USING (y, x))
    SELECT folder, count(*) AS pixels, R6(avg((r < 0)::INT)) AS negative_share, R6(avg((r = 0)::INT)) AS zero_share, R6(avg((r > 0)::INT)) AS positive_share, R4(avg(r)) AS mean_difference,
      R4(quantile_cont(r::DOUBLE, 0.01)) AS p01, R4(quantile_cont(r::DOUBLE, 0.5)) AS p50, R4(quantile_cont(r::DOUBLE, 0.99)) AS p99, R6(avg(dn / d)) AS mean_ratio FROM j GROUP BY folder""")
def _(t: Tables):
    px = t.pixels_anywhere()
    dark = px.where("folder = 0").groupBy("y", "x").agg(F.floor(F.avg("dn")).alias("d"))
    r = F.col("dn") - F.col("d")
    g = px.join(dark, ["y", "x"]).groupBy("folder").agg(
        F.count(F.lit(1)).alias("pixels"), F.avg((r < 0).cast("double")).alias("negative_share"), F.avg((r == 0).cast("double")).alias("zero_share"),
        F.avg((r > 0).cast("double")).alias("positive_share"), F.avg(r).alias("mean_difference"),
        F.percentile(r, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("_p"), F.avg(dbl("dn") / F.col("d")).alias("mean_ratio"))
    g = g.select("*", *[F.element_at("_p", i).alias(n) for i, n in ((1, "p01"), (2, "p50"), (3, "p99"))]).drop("_p")
    return sel(g, ["folder"], 4, negative_share=6, zero_share=6, positive_share=6, mean_ratio=6)
