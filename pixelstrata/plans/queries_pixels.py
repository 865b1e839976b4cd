"""Projection, filter and pixel scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelstrata.functions.scalars import big, flag_list, rnd, safe_div
from pixelstrata.operators import pairs as P
from pixelstrata.operators import pixels as X
from pixelstrata.operators.spatial import block_mean
from pixelstrata.operators.temporal import bad_pixel_mask
from pixelstrata.plans.queries_temporal import BAD_CTE, TOP, sel
from pixelstrata.plans.registry import query
from pixelstrata.plans.views import RANGE, Tables

FRAME_HASH = "sha256(folder || ':' || frame)"


def frame_hash():
    return F.sha2(F.concat_ws(":", F.col("folder").cast("string"), F.col("frame").cast("string")), 256)


@query("crop_center", """
    SELECT folder, frame, CAST(2 AS BIGINT) AS crop_top, CAST(2 AS BIGINT) AS crop_left, CAST(4 AS BIGINT) AS crop_size,
      count(*) AS pixels, CAST(sum(dn) AS BIGINT) AS total FROM fx_frames WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY folder, frame""")
def _(t: Tables):
    return X.crop_center(t.pixels(), 8, 8, 4).groupBy("folder", "frame", "crop_top", "crop_left", "crop_size").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("dn").alias("total"))


ROIS = {"center": (2, 2, 4, 4), "left": (0, 0, 8, 3), "full": (0, 0, 8, 8)}


@query("crop_roi", f"""
    SELECT folder, frame, roi, count(*) AS pixels, R4(avg(dn)) AS mean, min(dn) AS min, max(dn) AS max FROM fx_frames,
      (VALUES {", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, (a, b, c, d) in ROIS.items())}) r(roi, t, l, h, w)
    WHERE y >= t AND y < t + h AND x >= l AND x < l + w GROUP BY folder, frame, roi""")
def _(t: Tables):
    return sel(X.crop_rois(t.pixels(), ROIS).groupBy("folder", "frame", "roi").agg(
        F.count(F.lit(1)).alias("pixels"), F.avg("dn").alias("mean"), F.min("dn").alias("min"), F.max("dn").alias("max")), ["folder", "frame", "roi"])


@query("crop_patch", """
    WITH h AS (SELECT *, sha256(pair_key) AS h FROM fx_pairs),
      p AS (SELECT *, CAST(2 * (('0x' || substr(h, 1, 8))::UBIGINT % 3) AS BIGINT) AS patch_top,
              CAST(2 * (('0x' || substr(h, 9, 8))::UBIGINT % 3) AS BIGINT) AS patch_left FROM h)
    SELECT pair_key, patch_top, patch_left, y - patch_top AS py, x - patch_left AS px, clean, noisy FROM p
    WHERE y >= patch_top AND y < patch_top + 4 AND x >= patch_left AND x < patch_left + 4""")
def _(t: Tables):
    d = X.crop_patch(t.pairs(), F.sha2("pair_key", 256), 8, 8, 4)
    return d.select("pair_key", "patch_top", "patch_left", (F.col("y") - F.col("patch_top")).alias("py"),
                    (F.col("x") - F.col("patch_left")).alias("px"), "clean", "noisy")


@query("pixel_stride", "SELECT folder, frame, y, x, dn FROM fx_frames WHERE y % 2 = 0 AND x % 2 = 0")
def _(t: Tables):
    return X.pixel_stride(t.pixels_anywhere(), 2)


@query("normalize_clip", "SELECT folder, frame, y, x, R8(least(greatest(dn / 40000.0, 0), 1)) AS value FROM fx_frames")
def _(t: Tables):
    return t.pixels_anywhere().select("folder", "frame", "y", "x", rnd(X.normalize_clip("dn", 40000.0), 8).alias("value"))


@query("augment_coords", f"""
    WITH c AS (SELECT *, CAST(('0x' || substr({FRAME_HASH}, 1, 4))::UBIGINT % 16 AS BIGINT) AS code FROM fx_frames),
      k AS (SELECT *, code % 4 AS turns, (code // 4) % 2 AS flip_x, (code // 8) % 2 AS flip_y FROM c),
      r AS (SELECT *, CASE turns WHEN 0 THEN y WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y ELSE x END AS ry,
              CASE turns WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 7 - x ELSE 7 - y END AS rx FROM k)
    SELECT folder, frame, turns, flip_x, flip_y, CASE flip_y WHEN 1 THEN 7 - ry ELSE ry END AS y,
      CASE flip_x WHEN 1 THEN 7 - rx ELSE rx END AS x, dn FROM r""")
def _(t: Tables):
    return X.augment_coords(t.pixels_anywhere(), frame_hash(), 8).select("folder", "frame", "turns", "flip_x", "flip_y", "y", "x", "dn")


@query("channel_layout", """
    SELECT folder, CAST(0 AS BIGINT) AS band, y, x, count(*) AS images, CAST(sum(dn) AS BIGINT) AS total FROM fx_frames GROUP BY folder, y, x""")
def _(t: Tables):
    a = lambda *v: F.array(*[F.lit(i) for i in v])
    tl = t.tiles().withColumn("dims", F.when(F.col("frame") % 3 == 0, a(1, 8, 8)).when(F.col("frame") % 3 == 1, a(8, 8, 1)).otherwise(a(8, 8)))
    return X.channel_layout(tl, ["folder"], "dims", "dn").groupBy("folder", "band", "y", "x").agg(
        F.count(F.lit(1)).alias("images"), F.sum("value").alias("total"))


VALID_CTE = BAD_CTE + """,
    v AS (SELECT p.*, clean > 0 AND noisy > 0 AND clean < 65535 AND noisy < 65535 AND NOT coalesce(bad, false) AS valid
          FROM fx_pairs p LEFT JOIN (SELECT folder, y, x, bad FROM bad) b USING (folder, y, x)),
    dark AS (SELECT y, x, CAST(floor(sum(dn) / count(*) / 2) AS BIGINT) AS dark FROM fx_frames WHERE folder = 0 GROUP BY y, x)"""


def masked(t: Tables):
    return P.valid_mask(t.pairs(), bad_pixel_mask(t.pixels_anywhere(), TOP, 3.0), TOP)


def dark_map(t: Tables):
    """Stand-in dark map: half of the mean of folder 0, as an integer (one image: broadcast by size)."""
    return t.pixels_anywhere().where("folder = 0").groupBy("y", "x").agg(
        F.floor(F.sum("dn") / F.count(F.lit(1)) / 2).cast("bigint").alias("dark"))


@query("valid_mask", f"WITH {VALID_CTE} SELECT pair_key, count(*) AS pixels, sum(valid::INT)::BIGINT AS valid_pixels FROM v GROUP BY pair_key")
def _(t: Tables):
    return masked(t).groupBy("pair_key").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("valid").cast("bigint")).alias("valid_pixels"))


@query("dark_correct_fill", f"""WITH {VALID_CTE},
    d AS (SELECT pair_key, y, x, valid, least(greatest(noisy - dark, 0), 65535) AS diff FROM v JOIN dark USING (y, x)),
    m AS (SELECT pair_key, median(diff::DOUBLE) FILTER (valid) AS med FROM d GROUP BY pair_key)
    SELECT pair_key, y, x, R8(CASE WHEN valid THEN diff ELSE med END / 65535.0) AS corrected FROM d JOIN m USING (pair_key)""")
def _(t: Tables):
    d = masked(t).join(dark_map(t), ["y", "x"])
    return sel(P.dark_correct_fill(d, ["pair_key"], "noisy", "dark", "valid", RANGE).select("pair_key", "y", "x", "corrected"), ["pair_key", "y", "x"], 8)


@query("scale_to_p99", f"""WITH {VALID_CTE},
    p AS (SELECT pair_key, quantile_cont(clean::DOUBLE, 0.99) FILTER (valid) / 65535.0 AS p99 FROM v GROUP BY pair_key)
    SELECT pair_key, R8(0.9 / any_value(p99)) AS scale, R8(avg(least(greatest(clean / 65535.0 * (0.9 / p99), 0), 1))) AS scaled_mean,
      R8(max(least(greatest(clean / 65535.0 * (0.9 / p99), 0), 1))) AS scaled_max FROM v JOIN p USING (pair_key) GROUP BY pair_key""")
def _(t: Tables):
    s = P.scale_to_p99(masked(t), ["pair_key"], "clean", "valid", 0.9, RANGE)
    return sel(s.groupBy("pair_key").agg(F.max("scale").alias("scale"), F.avg("scaled").alias("scaled_mean"), F.max("scaled").alias("scaled_max")), ["pair_key"], 8)


@query("scale_to_mean_u16", """
    WITH m AS (SELECT folder, frame, avg(dn) AS sm FROM fx_frames GROUP BY ALL),
      s AS (SELECT folder, frame, dn, sm, 20000.0::DOUBLE / sm AS g, dn * (20000.0::DOUBLE / sm) AS f FROM fx_frames JOIN m USING (folder, frame)),
      q AS (SELECT *, CAST(round_even(least(greatest(f, 0), 65535), 0) AS BIGINT) AS q FROM s)
    SELECT folder, frame, R4(any_value(sm)) AS source_mean, R8(any_value(g)) AS gain, R4(avg(q)) AS scaled_mean,
      R8(abs(avg(q) - 20000) / 20000) AS relative_mean_error, R6(avg((dn = 0)::INT)) AS source_zero_ratio, R6(avg((q = 0)::INT)) AS scaled_zero_ratio,
      R6(greatest(0, avg((q = 0)::INT) - avg((dn = 0)::INT))) AS added_zero_ratio, R6(avg((q = 65535)::INT)) AS clipping_high_ratio,
      count(DISTINCT q) AS unique_values, R4(stddev_pop(q)) AS scaled_std,
      R4(quantile_cont(q::DOUBLE, 0.99) - quantile_cont(q::DOUBLE, 0.01)) AS dynamic_range, R6(max(abs(f - q))) AS round_trip_max_error
    FROM q GROUP BY folder, frame""")
def _(t: Tables):
    return sel(P.scale_to_mean_u16(t.pixels(), ["folder", "frame"], "dn", 20000.0, TOP), ["folder", "frame"], 4, gain=8, relative_mean_error=8,
               source_zero_ratio=6, scaled_zero_ratio=6, added_zero_ratio=6, clipping_high_ratio=6, round_trip_max_error=6)


TARGET_STD_CTE = "ts AS (SELECT folder, avg(std1) / 2 AS target FROM fx_maps GROUP BY folder)"


def with_target(t: Tables):
    from pixelstrata.operators.temporal import temporal_maps
    target = temporal_maps(t.pixels_anywhere()).groupBy("folder").agg((F.avg("std1") / 2).alias("target"))
    return t.pairs().join(target, "folder")


@query("rescale_residual", f"""WITH {TARGET_STD_CTE},
    g AS (SELECT pair_key, avg(noisy - clean) AS m, stddev_samp(noisy - clean) AS s FROM fx_pairs GROUP BY pair_key),
    j AS (SELECT p.*, m, s, least(greatest(target / s, 0.4), 0.6) AS scale FROM fx_pairs p JOIN g USING (pair_key) JOIN ts USING (folder))
    SELECT pair_key, R4(any_value(s)) AS base_std, R8(any_value(scale)) AS scale,
      R8(avg(least(greatest((clean + (noisy - clean - m) * scale) / 65535, 0), 1))) AS mean,
      R8(stddev_samp(least(greatest((clean + (noisy - clean - m) * scale) / 65535, 0), 1))) AS std FROM j GROUP BY pair_key""")
def _(t: Tables):
    r = P.rescale_residual(with_target(t), ["pair_key"], "target", 0.4, 0.6, RANGE)
    g = r.groupBy("pair_key").agg(F.max("base_std").alias("base_std"), F.max("scale").alias("scale"), F.avg("rescaled").alias("mean"), F.stddev_samp("rescaled").alias("std"))
    return sel(g, ["pair_key"], 8, base_std=4)


@query("u16_round_trip", """
    WITH v AS (SELECT folder, frame, dn / 50000.0::DOUBLE AS v FROM fx_frames),
      q AS (SELECT *, round_even(least(greatest(v, 0), 1) * 65535, 0) AS q FROM v)
    SELECT folder, frame, R8(max(abs(q / 65535 - v))) AS max_error, R8(abs(stddev_pop(q / 65535) - stddev_pop(v))) AS std_error,
      R6(avg((q = 0)::INT) - avg((v = 0)::INT)) AS zero_ratio_change, R6(avg((q = 65535)::INT) - avg((v = 1)::INT)) AS one_ratio_change
    FROM q GROUP BY folder, frame""")
def _(t: Tables):
    v = t.pixels().withColumn("v", F.col("dn").cast("double") / 50000.0)
    return sel(P.u16_round_trip(v, ["folder", "frame"], "v", TOP), ["folder", "frame"], 8, zero_ratio_change=6, one_ratio_change=6)


@query("block_mean", "SELECT folder, frame, y // 2 AS y, x // 2 AS x, R4(avg(dn)) AS dn FROM fx_frames GROUP BY folder, frame, y // 2, x // 2")
def _(t: Tables):
    return sel(block_mean(t.pixels(), ["folder", "frame"], "dn", 2), ["folder", "frame", "y", "x"])


THUMB_CTE = """
    sm AS (SELECT folder, frame, y, x, dn FROM fx_frames WHERE y % 2 = 0 AND x % 2 = 0),
    qq AS (SELECT folder, frame, quantile_cont(dn::DOUBLE, 0.01) AS a, quantile_cont(dn::DOUBLE, 0.99) AS b FROM sm GROUP BY ALL),
    cl AS (SELECT folder, frame, y, x, least(greatest((dn - a) / greatest(b - a, 1e-6), 0), 1) AS v FROM sm JOIN qq USING (folder, frame)),
    ce AS (SELECT folder, frame, y, x, v - avg(v) OVER (PARTITION BY folder, frame) AS v FROM cl),
    thumb AS (SELECT folder, frame, y, x, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY folder, frame)), 1e-12) AS v FROM ce)"""


@query("thumbnail_robust", f"WITH {THUMB_CTE} SELECT folder, frame, row_number() OVER (PARTITION BY folder, frame ORDER BY y, x) - 1 AS pos, R8(v) AS value FROM thumb")
def _(t: Tables):
    v = X.thumbnail_robust(t.pixels(), ["folder", "frame"], 2, 0.01, 0.99)
    return v.select("folder", "frame", F.posexplode("vec").alias("pos", "value")).select("folder", "frame", big("pos").alias("pos"), rnd("value", 8).alias("value"))


@query("safe_div", """
    SELECT folder, frame, R6(CASE WHEN frame % 5 = 0 THEN NULL ELSE avg(dn) / (frame % 5) END) AS quotient FROM fx_frames GROUP BY folder, frame""")
def _(t: Tables):
    g = t.pixels().groupBy("folder", "frame").agg(F.avg("dn").alias("m"))
    return g.select("folder", "frame", rnd(safe_div("m", F.col("frame") % 5), 6).alias("quotient"))


@query("flag_set", """
    SELECT folder, frame, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN sd > 4500 THEN 'noisy' END,
      CASE WHEN m > 32700 THEN 'bright' END, CASE WHEN m < 32000 THEN 'dark' END, CASE WHEN mx > 45000 THEN 'bright' END], lambda v: v IS NOT NULL))), ';') AS warning_flags
    FROM (SELECT folder, frame, avg(dn) AS m, stddev_pop(dn) AS sd, max(dn) AS mx FROM fx_frames GROUP BY ALL)""")
def _(t: Tables):
    g = t.pixels().groupBy("folder", "frame").agg(F.avg("dn").alias("m"), F.stddev_pop("dn").alias("sd"), F.max("dn").alias("mx"))
    return g.select("folder", "frame", flag_list(
        ("noisy", F.col("sd") > 4500), ("bright", F.col("m") > 32700), ("dark", F.col("m") < 32000), ("bright", F.col("mx") > 45000)).alias("warning_flags"))
