"""Invariants on hand-made frames and tables."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelstrata.operators import curation as C
from pixelstrata.operators import inference as I
from pixelstrata.operators import joins as J
from pixelstrata.operators import pairs as P
from pixelstrata.operators import similarity as M
from pixelstrata.operators import spectral as S
from pixelstrata.operators import temporal as T
from pixelstrata.operators import tiles as L
from pixelstrata.operators.frames import explode_tiles, tile_pixels
from pixelstrata.operators.spatial import gaussian_highpass, sobel


def pixels(spark, stack, folder=1):
    n, h, w = stack.shape
    f, y, x = np.meshgrid(np.arange(1, n + 1), np.arange(h), np.arange(w), indexing="ij")
    return spark.createDataFrame(pd.DataFrame({"folder": folder, "frame": f.ravel(), "y": y.ravel(), "x": x.ravel(), "dn": stack.ravel()}))


def tiles_of(spark, stack, side):
    """(folder, frame, place, dn) rows of a stack in tiles of ``side`` pixels."""
    n, h, w = stack.shape
    rows = [(1, f + 1, t, c, *stack[f, t : t + side, c : c + side].shape, stack[f, t : t + side, c : c + side].ravel().tolist()) for f in range(n) for t in range(0, h, side) for c in range(0, w, side)]
    return spark.createDataFrame(rows, "folder int, frame long, top int, left int, h int, w int, dn array<double>")


def out_rows(spark, raw, out):
    a = pixels(spark, raw).withColumnRenamed("dn", "raw")
    b = pixels(spark, out).withColumnRenamed("dn", "value")
    return a.join(b, ["folder", "frame", "y", "x"]).withColumn("strategy", F.lit("m"))


@pytest.fixture(scope="module")
def stack():
    return np.random.default_rng(4).normal(1000, 20, (12, 8, 6))


def test_halved_residuals_reduce_variance_by_three_quarters(spark, stack):
    half = stack.mean(0) + (stack - stack.mean(0)) / 2
    r = T.temporal_reduction(out_rows(spark, stack, half)).collect()[0]
    assert r.reduction == pytest.approx(0.75)
    a = T.row_column_energy(T.temporal_residual(pixels(spark, stack)), 4)[0].collect()[0]
    b = T.row_column_energy(T.temporal_residual(pixels(spark, half)), 4)[0].collect()[0]
    assert b.row_energy / a.row_energy == pytest.approx(0.5)


def test_frame_offsets_vanish_after_centering(spark, stack):
    shifted = stack + np.arange(12)[:, None, None] * 3.0
    r = T.temporal_reduction(out_rows(spark, stack, shifted)).collect()[0]
    assert r.centered_reduction == pytest.approx(0, abs=1e-9) and r.restored_reduction == pytest.approx(0, abs=1e-9)
    d = P.dc_restore_summary(out_rows(spark, stack, shifted), 65535).collect()[0]
    assert d.shift_after == pytest.approx(0, abs=1e-9) and d.shift_before == pytest.approx(16.5)


def test_constant_offset_keeps_gradients(spark, stack):
    a = sobel(pixels(spark, stack), ["folder", "frame"], "dn").agg(F.avg("sobel")).collect()[0][0]
    b = sobel(pixels(spark, stack + 5), ["folder", "frame"], "dn").agg(F.avg("sobel")).collect()[0][0]
    assert a == pytest.approx(b)
    assert P.removed_residual(out_rows(spark, stack + 5, stack), 0.3).collect()[0].removed_mean == pytest.approx(5)


def test_spectra(spark):
    flat = np.ones((4, 8, 8)) * np.array([1.0, 2, 3, 4])[:, None, None]
    board = np.indices((8, 8)).sum(0) % 2 * 2.0 - 1
    signs = np.array([1.0, -1, 1, -1])[:, None, None]
    for s, band, share in ((flat, "dc_fraction", 0.999), (board[None] * signs, "high_fraction", 0.99)):
        p = S.power_spectrum(S.power_blocks(L.tile_residual(tiles_of(spark, s, 5), demean=False), ["folder"]), ["folder"])
        assert S.band_fractions(p, ["folder"], (0.126, 0.26, 0.4)).collect()[0][band] > share


@pytest.mark.parametrize("side,block", [(3, 40), (8, 1 << 20)])
def test_spectra_equal_numpy_whatever_the_tiles(spark, stack, monkeypatch, side, block):
    monkeypatch.setattr(S, "GROUP_VALUES", block)
    monkeypatch.setattr(S, "IMAGES", 2)
    monkeypatch.setattr(S, "FAN_IN", 2)
    grid = lambda d, c: d.toPandas().sort_values([x for x in ("v", "u", "dy", "dx") if x in d.columns])[c].to_numpy()
    for odd in (stack, stack[:, :7, :5]):
        tiles, r = tiles_of(spark, odd, side), odd - odd.mean(0)
        h, w = r.shape[1:]
        blocks = S.power_blocks(L.tile_residual(tiles, demean=False), ["folder"])
        power = (np.abs(np.fft.fft2(r)) ** 2).mean(0)
        assert np.allclose(grid(S.power_spectrum(blocks, ["folder"]), "power").reshape(h, w), np.fft.fftshift(power))
        acf = np.fft.fftshift(np.fft.ifft2(power).real)
        assert np.allclose(grid(S.acf_from_power(blocks, ["folder"]), "acf").reshape(h, w), acf / acf[h // 2, w // 2])
        d = r - r.mean((1, 2), keepdims=True)
        win = np.hanning(h)[:, None] * np.hanning(w)
        got = S.power_spectrum(S.power_blocks(L.tile_residual(tiles), ["folder"], hann=True), ["folder"])
        assert np.allclose(grid(got, "power").reshape(h, w), np.fft.fftshift((np.abs(np.fft.fft2(d * win)) ** 2).mean(0)) / (win * win).sum())
        cov = grid(S.autocovariance(S.power_blocks(L.tile_residual(tiles), ["folder"], pad=2), ["folder"], 2), "covariance").reshape(5, 5)
        for y in range(-2, 3):
            for x in range(-2, 3):
                a = d[:, max(0, y) : h + min(0, y), max(0, x) : w + min(0, x)]
                b = d[:, max(0, -y) : h + min(0, -y), max(0, -x) : w + min(0, -x)]
                assert cov[y + 2, x + 2] == pytest.approx((a * b).mean())


def test_incomplete_frames_are_refused(spark, stack):
    tiles = tiles_of(spark, stack, 3).where("not (frame = 4 and top = 3 and left = 3)")
    with pytest.raises(Exception, match="whole rows"):
        S.power_blocks(tiles.withColumn("r", F.col("dn").cast("array<double>")), ["folder"]).collect()


def test_spectrum_of_a_wide_frame_in_small_groups(spark):
    img = np.random.default_rng(8).normal(size=(1, 512, 512))
    rows = [(1, 1, t, c, 128, 128, img[0, t : t + 128, c : c + 128].ravel().tolist()) for t in range(0, 512, 128) for c in range(0, 512, 128)]
    tiles = spark.createDataFrame(rows, "folder int, frame long, top int, left int, h int, w int, r array<double>")
    got = S.power_spectrum(S.power_blocks(tiles, ["folder"]), ["folder"]).toPandas().sort_values(["v", "u"]).power.to_numpy().reshape(512, 512)
    assert np.allclose(got, np.fft.fftshift(np.abs(np.fft.fft2(img[0])) ** 2))


def test_moments_merge_over_partitions(spark, stack):
    tiles = tiles_of(spark, stack, 5).repartition(40)
    got = L.tile_moments(tiles, ["folder"]).collect()
    for r in got:
        part = stack[:, r.top : r.top + r.h, r.left : r.left + r.w].reshape(len(stack), -1)
        assert r.n == len(stack) and np.allclose(r["mean"], part.mean(0)) and np.allclose(r.m2, part.var(0) * len(stack))
    assert sum(len(r.m2) for r in got) == stack[0].size


def image_of(df, name, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r.top : r.top + r.h, r.left : r.left + r.w] = np.array(r[name], float).reshape(r.h, r.w)
    return out


@pytest.mark.parametrize("side,shape", [(3, (11, 8)), (4, (12, 8)), (16, (11, 8)), (2, (5, 7))])
def test_stencils_over_tile_borders_equal_the_whole_frame(spark, side, shape):
    h, w = shape
    img = np.random.default_rng(6).normal(size=(1, h, w))
    tiles, at = tiles_of(spark, img, side), L.Shape(h, w, min(side, h), 1)
    keys, a = ["folder", "frame"], img[0]
    g = L.stencil(tiles, keys, "dn", 1, at, L.central, ["gy", "gx", "grad"], "nan")
    gy, gx = np.gradient(a)
    assert np.allclose(image_of(g, "gy", h, w), gy) and np.allclose(image_of(g, "gx", h, w), gx)
    b = image_of(L.stencil(tiles, keys, "dn", 2, at, L.box(2), ["local_mean", "local_std"], "nan"), "local_std", h, w)
    for y in range(h):
        for x in range(w):
            inner = 2 <= y < h - 2 and 2 <= x < w - 2
            assert b[y, x] == pytest.approx(a[y - 2 : y + 3, x - 2 : x + 3].std()) if inner else np.isnan(b[y, x])
    k = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    k /= k.sum()
    wide = np.take(np.take(a, [_r(i, h) for i in range(-8, h + 8)], 0), [_r(i, w) for i in range(-8, w + 8)], 1)
    low = np.array([[(wide[y : y + 17, x : x + 17] * np.outer(k, k)).sum() for x in range(w)] for y in range(h)])
    got = L.stencil(tiles, keys, "dn", 8, at, L.blur(list(zip(range(-8, 9), k))), ["low", "hp"], "reflect")
    assert np.allclose(image_of(got, "hp", h, w), a - low)
    p = {(r.dy, r.dx): (r.n, r.total) for r in L.lag_products(tiles, ["folder"], "dn", 1, at).collect()}
    assert p[(1, -1)] == (pytest.approx((h - 1) * (w - 1)), pytest.approx((a[:-1, 1:] * a[1:, :-1]).sum())) and len(p) == 6


def test_lags_reach_over_chunks_of_frames(spark, stack):
    r = stack - stack.mean(0)
    d = L.lagged_tiles(tiles_of(spark, r, 5), ["folder"], "dn", [1, 7], L.pair_sums, L.PAIR_SUMS, chunk=3).groupBy("frame", "lag").agg(L.corr_of_sums().alias("c")).collect()
    got = {(x.frame, x.lag): x.c for x in d}
    assert set(got) == {(f, lag) for lag in (1, 7) for f in range(1, 13 - lag)}
    for (f, lag), c in got.items():
        assert c == pytest.approx(np.corrcoef(r[f - 1].ravel(), r[f - 1 + lag].ravel())[0, 1])


def test_crops_and_counts_from_one_scan(spark, stack):
    g = T.robustness_grid(tiles_of(spark, stack, 3).repartition(20), 8, 6, [4, 99], [5, None, 50]).collect()
    assert {(r.crop, r.frames) for r in g} == {(c, n) for c in (4, 99) for n in (5, 0, 50)}
    for r in g:
        part = stack[: r.frames or None]
        part = part[:, 2:6, 1:5] if r.crop == 4 else part[:, 1:7] if r.crop == 6 else part[:, 1:7, 0:6]
        m, v = part.mean(0), part.var(0, ddof=1)
        want = (len(part), m.mean(), m.std(ddof=1), np.sqrt(v).mean(), v.mean(), part.mean((1, 2)).std(ddof=1))
        assert (r.frame_count, r.mean_signal, r.fixed_std, r.temporal_std_mean, r.temporal_var_mean, r.frame_mean_std) == pytest.approx(want)


def test_gaussian_highpass_reflects_edges(spark):
    img = np.random.default_rng(2).normal(size=(1, 5, 7))
    got = gaussian_highpass(pixels(spark, img), ["folder", "frame"], "dn", 2.0).toPandas().sort_values(["y", "x"]).hp.to_numpy().reshape(5, 7)
    k = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    k /= k.sum()
    a = np.take(np.take(img[0], [_r(i, 5) for i in range(-8, 13)], 0), [_r(i, 7) for i in range(-8, 15)], 1)
    low = np.array([[(a[y:y + 17, x:x + 17] * np.outer(k, k)).sum() for x in range(7)] for y in range(5)])
    assert np.allclose(got, img[0] - low)


def _r(i, n):
    j = i % (2 * n)
    return 2 * n - 1 - j if j >= n else j


def test_ssim_windowed_equals_direct(spark):
    r = np.random.default_rng(5)
    a = r.normal(100, 10, (1, 9, 10))
    b = a + r.normal(0, 4, a.shape)
    df = pixels(spark, a).withColumnRenamed("dn", "clean").join(pixels(spark, b).withColumnRenamed("dn", "noisy"), ["folder", "frame", "y", "x"])
    got = P.ssim_windowed(df, ["frame"], "noisy", "clean", 255.0).collect()[0].ssim
    c1, c2, vals = (0.01 * 255) ** 2, (0.03 * 255) ** 2, []
    for y in range(3):
        for x in range(4):
            p, q = a[0, y:y + 7, x:x + 7].ravel(), b[0, y:y + 7, x:x + 7].ravel()
            cov = np.cov(p, q)
            vals.append((2 * p.mean() * q.mean() + c1) * (2 * cov[0, 1] + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
    assert got == pytest.approx(np.mean(vals))


def test_registration_finds_a_known_shift(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(16, 16))
    frames = np.stack([np.roll(base, s, axis=(0, 1)) for s in ((0, 0), (0, 0), (0, 0), (2, 0))]) * 100 + 1000
    t = tile_pixels(pixels(spark, frames), ["folder", "frame"], 16)
    s = T.registration_shift(t, 1, sigma=0.0).collect()[0]
    assert s.groups == 4 and s.shift_max == pytest.approx(2.0, abs=0.1)
    y, x = np.mgrid[0:32, 0:32]
    spot = sum(np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 8) for cy, cx in ((8, 9), (20, 14), (15, 25))) * 1000
    noisy = np.stack([np.roll(spot, s, axis=(0, 1)) + r.normal(size=(32, 32)) * 40 for s in ((0, 0), (0, 0), (0, 0), (6, 0))]) + 1000
    s = T.registration_shift(tile_pixels(pixels(spark, noisy), ["folder", "frame"], 32), 1).collect()[0]
    assert s.shift_max == pytest.approx(6.0, abs=0.3)  # noise in every pixel does not move the peak


def test_tiles_round_trip(spark, stack):
    px = pixels(spark, np.rint(stack).astype(int))
    back = explode_tiles(tile_pixels(px, ["folder", "frame"], 4))
    assert back.exceptAll(px.select(back.columns)).count() == 0 and back.count() == px.count()


def test_linear_fit_recovers_its_line(spark):
    x = np.linspace(100, 900, 9)
    df = spark.createDataFrame(pd.DataFrame({"folder": range(9), "m": x, "s": 2 + 0.01 * x}))
    f = {r.model: r for r in I.signal_noise_fit(df, "m", "s").collect()}
    assert f["std_linear"].a == pytest.approx(2, abs=1e-9) and f["std_linear"].b == pytest.approx(0.01) and f["std_linear"].r2 > 0.999999
    assert f["std_nonnegative"].a == pytest.approx(2, abs=1e-9)
    loo = I.loo_fit(df, "folder", "m", "s").where("model = 'std_linear'").agg(F.max(F.abs("error"))).collect()[0][0]
    assert loo < 1e-8


def test_nonnegative_fit_on_the_boundary(spark):
    df = spark.createDataFrame([(i, float(x), float(s)) for i, (x, s) in enumerate([(1, 0.1), (2, 1.9), (3, 4.2), (4, 6.1)])], "folder int, m double, s double")
    r = I.signal_noise_fit(df, "m", "s", ["std_nonnegative"]).collect()[0]
    x, s = np.array([1, 2, 3, 4.0]), np.array([0.1, 1.9, 4.2, 6.1])
    assert r.a == 0 and r.b == pytest.approx((x * s).sum() / (x * x).sum())


def condition_frame(n=14, seed=0):
    r = np.random.default_rng(seed)
    d = pd.DataFrame(r.normal(size=(n, 3)), columns=["a", "b", "c"])
    d["c"] = d.a * 0.7 + d.c * 0.4
    d["folder"] = np.arange(n)
    d["y"] = d.a - 0.5 * d.b + r.normal(size=n) * 0.1
    return d


def test_vif_pca_ridge_equal_numpy(spark):
    d = condition_frame()
    df = spark.createDataFrame(d)
    m = np.corrcoef(d[["a", "b", "c"]].T)
    v = {r.feature: r.vif for r in I.vif(df, ["a", "b", "c"]).collect()}
    assert [v[k] for k in "abc"] == pytest.approx(np.diag(np.linalg.inv(m)).tolist())
    p = I.pca_variance(df, ["a", "b", "c"]).toPandas().drop_duplicates("component").sort_values("component").explained
    assert np.allclose(p, np.sort(np.linalg.eigvalsh(m))[::-1] / 3)
    got = {r.heldout: r for r in I.lofo_ridge(df, "folder", "y", ["a", "b", "c"]).collect()}
    for k in range(len(d)):
        tr, te = d[d.folder != k], d[d.folder == k]
        mu, sd, ym = tr[["a", "b", "c"]].mean(), tr[["a", "b", "c"]].std(ddof=0), tr.y.mean()
        z = ((tr[["a", "b", "c"]] - mu) / sd).to_numpy()
        beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (tr.y - ym))
        err = te.y.iloc[0] - ym - ((te[["a", "b", "c"]] - mu) / sd).to_numpy()[0] @ beta
        assert got[k].ridge_rmse == pytest.approx(abs(err), abs=1e-9) and got[k].null_rmse == pytest.approx(abs(te.y.iloc[0] - ym), abs=1e-9)


def test_one_hot_fit_equals_least_squares(spark):
    r = np.random.default_rng(8)
    d = pd.DataFrame({"f": r.integers(0, 3, 60).astype(str), "s": r.integers(0, 2, 60).astype(str), "y": r.normal(size=60)})
    got = {x.term: x.coefficient for x in I.ols_one_hot(spark.createDataFrame(d), ["f", "s"], "y").collect()}
    X = np.column_stack([np.ones(60), d.f == "1", d.f == "2", d.s == "1"]).astype(float)
    want = np.linalg.lstsq(X, d.y, rcond=None)[0]
    assert [got[k] for k in ("intercept", "f=1", "f=2", "s=1")] == pytest.approx(want.tolist())


def test_exact_permutation_by_enumeration(spark):
    import itertools
    x, y = [3.0, 1.0, 4.0, 1.5, 9.0, 2.0], [2.0, 7.0, 1.0, 8.0, 2.5, 0.0]
    df = spark.createDataFrame([("g", i, a, b) for i, (a, b) in enumerate(zip(x, y))], "g string, u int, x double, y double")
    r = I.exact_permutation(df, "g", "u", "x", "y").collect()[0]
    rx, ry = pd.Series(x).rank().to_numpy() - 3.5, pd.Series(y).rank().to_numpy() - 3.5
    d = math.sqrt((rx @ rx) * (ry @ ry))
    hits = sum(abs(rx @ ry[list(p)] / d) >= abs(rx @ ry / d) - 1e-12 for p in itertools.permutations(range(6)))
    assert (r.exceed, r.permutations) == (hits, 720)


def test_keyed_permutations_are_a_bijection():
    import itertools

    from pixelstrata.functions.resampling import keyed_permutations
    for n, seed in ((2, 3), (3, 1), (5, 7), (7, 2)):
        got = np.concatenate([keyed_permutations(a, min(50, math.factorial(n) - a), n, seed) for a in range(0, math.factorial(n), 50)])
        assert sorted(map(tuple, got)) == sorted(itertools.permutations(range(n)))
    many = keyed_permutations(0, 60_000, 25, 4)
    assert (np.sort(many, 1) == np.arange(25)).all() and len(np.unique(many, axis=0)) == 60_000
    places = np.array([np.bincount(many[:, k], minlength=25) for k in range(25)])
    assert abs(places / 2400 - 1).max() < 0.11  # each unit at each place about equally often (5 sigma)


def test_share_interval_covers():
    from pixelstrata.functions.resampling import share_interval
    rng = np.random.default_rng(1)
    for p in (0.0, 0.003, 0.05, 0.5, 1.0):
        bounds = [share_interval(int(h), 2000, 0.05) for h in rng.binomial(2000, p, 300)]
        assert np.mean([a <= p <= b for a, b in bounds]) >= 0.95
    assert share_interval(0, 10, 0.05)[0] == 0 and share_interval(10, 10, 0.05)[1] == 1


def test_sampled_permutation(spark):
    rng = np.random.default_rng(5)
    rows = [(g, i, float(a), float(a * 0.4 + b)) for g in "pq" for i, (a, b) in enumerate(rng.normal(size=(10, 2)))]
    df = spark.createDataFrame(rows, "g string, u int, x double, y double")
    exact = I.exact_permutation(df, "g", "u", "x", "y").collect()[0]
    part = I.sampled_permutation(df, "g", "u", "x", "y", draws=200_000, seed=3).collect()[0]
    assert part.permutations == 200_000 and not part.exact and part.p_low <= exact.p_value <= part.p_high and part.p_high - part.p_low < 0.02
    assert part.observed_abs == pytest.approx(exact.observed_abs)
    every = I.sampled_permutation(df, "g", "u", "x", "y", draws=1 << 22, seed=4).collect()[0]
    assert (every.exceed, every.permutations, every.exact, every.p_low) == (exact.exceed, exact.permutations, True, exact.p_value)
    line = spark.createDataFrame([("p", i, float(i), float(-i)) for i in range(25)], "g string, u int, x double, y double")
    early = I.sampled_permutation(line, "g", "u", "x", "y", draws=1 << 20, alpha=0.05).collect()[0]
    assert (early.exceed, early.permutations, early.p_low) == (0, 1 << 14, 0.0) and early.p_high < 0.05
    assert I.sampled_permutation(df.limit(0), "g", "u", "x", "y").count() == 0


def test_reliability_interval_and_association_parts(spark):
    rows = [("v", i, float(i), float(i) + (5.0 if i == 3 else 0.0), -float(i), float(i % 3), s) for i in range(10) for s in (0, 1)]
    df = spark.createDataFrame(rows, "v string, f int, a double, b double, y double, c double, s int")
    one = df.where("s = 0")
    r = I.split_half_reliability(one, "v", "f", "a", "b", 0.5, 200, 1).collect()[0]
    a, b = np.arange(10.0), np.arange(10.0) + np.where(np.arange(10) == 3, 5, 0)
    draws = [[int(hashlib.md5(f"1:{k}:{i}".encode()).hexdigest()[:8], 16) % 10 for i in range(10)] for k in range(200)]
    rho = np.array([pd.Series(a[d]).rank().corr(pd.Series(b[d]).rank()) for d in draws])
    assert [r.ci_low, r.boot_median, r.ci_high] == pytest.approx(np.quantile(rho, [0.025, 0.5, 0.975]).tolist())
    assert r.boot_positive == pytest.approx((rho > 1e-9).mean()) and r.passed and r.valid
    assert not I.split_half_reliability(one, "v", "f", "a", "b", 0.5, 20, 1, F.col("b") < 9).collect()[0].passed
    q = I.association_audit(one, "v", "f", "a", "y", "c", df, ("s",), 100, 1)
    g = I.association_decision(q.withColumn("p", F.lit(0.001)), "p", 10).collect()[0]
    assert g.rho == pytest.approx(-1) and g.ci_low == pytest.approx(-1) and (g.cells, g.cells_nonpositive) == (2, 2) and g.exceeds_control and abs(g.control_rho) < 1
    assert (g.loo_nonpositive, g.loo_medium) == (10, 10)


@pytest.mark.parametrize("size", [6, 12])
def test_subset_noise_of_tiles(spark, size):
    """Frames of one tile and of four against numpy."""
    rng = np.random.default_rng(8)
    stack = rng.normal(500, 20, size=(8, 12, 12)) + 30 * np.cumsum(rng.normal(size=(8, 12, 12)), 2) / 3
    rows = [(1, k + 1, y, x, size, size, stack[k, y : y + size, x : x + size].ravel().tolist()) for k in range(8) for y in range(0, 12, size) for x in range(0, 12, size)]
    tiles = spark.createDataFrame(rows, "folder long, frame long, top int, left int, h int, w int, dn array<double>")
    got = {r.subset: r for r in T.subset_noise(tiles, ["all", "odd"], (0.126, 0.26, 0.4)).collect()}
    window = np.hanning(12)[:, None] * np.hanning(12)
    f = np.round(np.hypot(np.fft.fftfreq(12)[:, None], np.fft.fftfreq(12)), 9)

    def lag(r, dy, dx):
        a, b = r[:, : 12 - dy, : 12 - dx], r[:, dy:, dx:]
        return (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())

    for name, part in (("all", stack), ("odd", stack[::2])):
        r = part - part.mean(0)
        r = r - r.mean((1, 2), keepdims=True)
        p = (np.abs(np.fft.fft2(r * window)) ** 2).mean(0)
        sd = part.std(0, ddof=1)
        want = {"temporal_std": sd.mean(), "mean_signal": part.mean(), "row_energy": math.sqrt((r.mean(2) ** 2).mean()), "column_energy": math.sqrt((r.mean(1) ** 2).mean()),
                "acf1": (lag(r, 0, 1) + lag(r, 1, 0) + 2 * lag(r, 1, 1)) / 4, "map_correlation": np.corrcoef(sd.ravel(), stack.std(0, ddof=1).ravel())[0, 1],
                "low_fraction": p[(f >= 0.126) & (f < 0.26)].sum() / p.sum(), "high_fraction": p[f >= 0.4].sum() / p.sum()}
        assert {k: got[name][k] for k in want} == pytest.approx(want)
    c = {r.subset: r for r in T.frame_convergence(T.subset_noise(tiles, ["all", "odd"], (0.126, 0.26, 0.4)), ["temporal_std"], ["acf1"], ["map_correlation"]).collect()}
    assert c["all"].temporal_std_error == 0 and c["odd"].acf1_error == pytest.approx(abs(got["odd"].acf1 - got["all"].acf1))


def test_chain_of_thousand_is_one_component(spark):
    nodes = spark.range(0, 1010).select(F.col("id"))
    edges = spark.range(0, 999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    lab = M.connected_components(nodes, edges)
    assert lab.where("component = 0").count() == 1000 and lab.select("component").distinct().count() == 11


def test_similarity_join_loses_nothing(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(60, 20))
    v = np.concatenate([base, base[:25] + r.normal(size=(25, 20)) * 0.05, np.repeat(base[:1], 40, axis=0)])
    v -= v.mean(1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[85:] = v[0]
    df = spark.createDataFrame([(i, [float(q) for q in row]) for i, row in enumerate(v)], "id long, vec array<double>")
    for t in (0.9, 0.99, 0.999):
        got = {(r.a, r.b) for r in M.similar_pairs(df, t, 20, blocks=8).where("kind = 'near_content'").collect()}
        c = v[:85] @ v[:85].T
        assert got == {(i, j) for i in range(85) for j in range(i + 1, 85) if c[i, j] >= t}
    star = M.similar_pairs(df, 0.999, 20, blocks=8).where("kind = 'exact_copy'").collect()
    assert {(r.a, r.b) for r in star} == {(0, j) for j in range(85, 125)}  # one edge per copy, not all pairs


def test_perceptual_hash_ignores_scale(spark):
    r = np.random.default_rng(1)
    a = r.normal(size=64)
    rows = [(1, a.tolist()), (2, (a * 3.5).tolist()), (3, r.normal(size=64).tolist())]
    h = {x.id: x.phash for x in M.perceptual_hash(spark.createDataFrame(rows, "id long, vec array<double>"), ["id"], "vec", 8).collect()}
    assert h[1] == h[2] != h[3]


def test_index_gaps(spark):
    df = spark.createDataFrame([(1, i) for i in (3, 4, 7, 5000, 5002)], "folder long, idx long")
    r = C.index_gaps(df).orderBy("gap_first").collect()
    assert [(x.gap_first, x.gap_last) for x in r] == [(5, 6), (8, 4999), (5001, 5001)] and {x.missing for x in r} == {5002 - 3 + 1 - 5}
    r = C.index_gaps(df, 0, 4).collect()
    assert [(x.gap_first, x.gap_last, x.missing, x.unexpected) for x in r] == [(0, 2, 3, 3)]
    whole = C.index_gaps(spark.range(10_000).selectExpr("1 AS folder", "id AS idx")).collect()
    assert [(x.gap_first, x.missing) for x in whole] == [(None, 0)]


def test_lofo_folds_are_isolated(spark):
    fr = spark.createDataFrame([(f, k) for f in range(4) for k in range(1, 28)], "folder long, frame long")
    roles = C.lofo_manifests(fr, 9, 0, list(range(1, 9)))
    assert C.lofo_leakage(roles).count() == 0
    assert roles.groupBy("fold").agg(F.count_distinct("folder")).where("`count(DISTINCT folder)` = 4").count() == 4


def test_greedy_pick_skips_used(spark):
    items = spark.createDataFrame([(i, v, f"{i:03d}") for i, v in enumerate([1, 2, 3, 10, 11])], "id long, v long, tie string")
    got = [r.id for r in J.nearest_quantile_pick(items, "id", "v", "tie", [0.5, 0.5, 0.5]).orderBy("selection_rank").collect()]
    assert got == [2, 1, 0]


def test_mask_and_gate_reasons(spark):
    rows = [("p", 0, 0, 10, 100, 50.0), ("p", 0, 1, 200, 0, 50.0), ("p", 1, 0, 300, 65535, 50.0)]
    df = spark.createDataFrame(rows, "pair_key string, y int, x int, clean long, noisy long, target double")
    lim = dict(std_relative_error=0.1, z_mean=2.0, residual_mean=10.0, zero_ratio=0.1, one_ratio=0.1)
    g = P.pair_moment_gate(df, ["pair_key"], "target", 65535, lim).collect()[0]
    assert g.fail_reasons == "ONE_CLIPPING;RESIDUAL_MEAN_SAFETY;RESIDUAL_MEAN_Z;SIGMA_ERROR;ZERO_CLIPPING" and not g.passed
    # zeros that the clean image has already are not added ones; without a z limit the brightness shift decides
    dark = spark.createDataFrame([("d", y, x, 0, 0, 1.0) for y in range(4) for x in range(4)], df.schema)
    g = P.pair_moment_gate(dark, ["pair_key"], "target", 65535, lim).collect()[0]
    assert (g.zero_ratio, g.added_zero_ratio) == (1.0, 0.0) and "ZERO_CLIPPING" not in g.fail_reasons and "NONFINITE" in g.fail_reasons
    bright = {k: v for k, v in lim.items() if k not in ("z_mean", "residual_mean")} | {"brightness_shift": 3.0}
    assert "BRIGHTNESS" in P.pair_moment_gate(df, ["pair_key"], "target", 65535, bright).collect()[0].fail_reasons


def test_bh_adjust(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    q = {r.p: r.q for r in I.bh_adjust(spark.createDataFrame([(x,) for x in p], "p double"), [], "p").collect()}
    assert [q[x] for x in p] == pytest.approx([0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


def test_rank_bootstrap_of_a_monotone_relation(spark):
    df = spark.createDataFrame([(g, i, float(i), float(s * i ** 3)) for g, s in (("p", 1), ("q", 2)) for i in range(8)], "g string, u int, x double, y double")
    r = I.folder_bootstrap_rho(df, "g", "u", "x", "y", 20, 5).collect()[0]
    assert r.rounds == 20 and (r.ci_low, r.median, r.ci_high) == pytest.approx((1.0, 1.0, 1.0))


def test_equal_hashes_become_star_links(spark):
    h = spark.createDataFrame([(i, v) for i, v in enumerate([7, 7, 8, 7])], "id long, phash long")
    got = sorted((r.first_key, r.other_key, r.group_size) for r in C.exact_duplicates(h, "id", "phash").collect())
    assert got == [(0, 1, 3), (0, 3, 3)]


def text_rows(rows):
    return [(i, t) for i, t in enumerate(rows)]


def test_similar_texts_match_all_pairs(spark):
    """Near pairs of a dense group and around the threshold, against every pair; copies as a star."""
    from pixelstrata.operators import text_similarity as X

    r = np.random.default_rng(8)
    rows = []
    for g in range(6):
        base = [f"w{x}" for x in r.integers(0, 10**6, 90)]
        for k in range(25):
            words = list(base)
            for at in r.choice(90, k // 3, replace=False):
                words[at] = f"x{r.integers(10**6)}"
            rows.append(" ".join(words))
    rows += [rows[0]] * 60 + ["one", "two words", "", " \n", "one  \n two", "digits 1 2 3", "digits 1 2 4"]
    df = spark.createDataFrame([*text_rows(rows), (999, None)], "id long, t string")
    got = X.similar_texts(X.text_sets(df, "id", "t"), 0.8).collect()
    sets = {}
    for i, t in text_rows(rows):
        w = t.split()
        s = {tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
        sets.setdefault(t, (i, s))
    own = sorted(sets.values(), key=lambda x: x[0])
    want = {(a, b): len(s & u) / len(s | u) for k, (a, s) in enumerate(own) for b, u in own[k + 1:] if s and u and len(s & u) >= 0.8 * len(s | u)}
    assert {(x.a, x.b): x.corr for x in got if x.kind == "near_content"} == want
    first = {i for i, _ in own}
    copies = [(i, t) for i, t in text_rows(rows) if i not in first]
    assert {(x.a, x.b) for x in got if x.kind == "exact_copy"} == {(sets[t][0], i) for i, t in copies} | {(sets[""][0], 999)}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_no_pair_is_lost_and_groups_agree(spark, monkeypatch, threshold):
    from pixelstrata.operators import text_similarity as X

    rng, rows = np.random.default_rng(7), []
    for g in range(15):
        base = rng.integers(0, 60, 40)
        for k in range(8):
            w = base.copy()
            at = rng.choice(40, k, replace=False)
            w[at] = rng.integers(0, 60, k)
            rows.append((len(rows), "all share this line and more " * (g % 2) + " ".join(f"w{x}" for x in w[: 40 - k % 3])))
    rows += [(500, None), (501, ""), (502, "one"), (503, "one"), (504, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, t string")
    sets = X.text_sets(df, "id", "t")
    full = {r.id: set(r.shingles) for r in sets.collect()}
    reps = {r.id for r in X.copies(sets)[0].collect()}
    want = {(a, b) for a in reps for b in reps if a < b and full[a] and full[b] and len(full[a] & full[b]) / len(full[a] | full[b]) >= threshold}
    assert {(r.a, r.b) for r in X.near_texts(X.copies(sets)[0], threshold).collect()} == want
    nodes = df.select("id")
    by = lambda e: {r.id: r.component for r in M.connected_components(nodes, e).collect()}
    assert by(X.linked_texts(sets, threshold)) == by(X.similar_texts(sets, threshold).select("a", "b"))


def test_hot_group_of_near_copies_costs_a_row_a_member(spark):
    from pixelstrata.operators import text_similarity as X

    base = [f"w{k}" for k in range(60)]
    rows = spark.range(20_000).select(F.col("id"), F.concat(F.lit(" ".join(base) + " x"), F.col("id").cast("string")).alias("t"))
    rows = rows.unionByName(spark.createDataFrame([(30_000, " ".join(base[:30]) + " other end"), (30_001, "apart"), (30_002, "apart")], "id long, t string"))
    e = X.linked_texts(X.text_sets(rows, "id", "t"), 0.8)
    assert e.count() <= 21_000
    sizes = sorted(r["count"] for r in M.connected_components(rows.select("id"), e).groupBy("component").count().collect())
    assert sizes == [1, 2, 20_000]


def test_shared_line_makes_no_candidates(spark):
    from pixelstrata.operators import text_similarity as X

    line = "every text of this table has this very line in it "
    docs = spark.createDataFrame([(k, line + " ".join(f"d{k}x{j}" for j in range(30))) for k in range(200)], "id long, t string")
    assert X.candidate_pairs(X.text_sets(docs, "id", "t"), 0.8).count() == 0


def test_contained_texts(spark):
    from pixelstrata.operators import text_similarity as X

    ref = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, f"before {ref} after " + "filler " * 50), (2, "nothing like it at all here"), (3, ref), (4, None)], "id long, t string")
    refs = spark.createDataFrame([(7, ref), (8, "")], "id long, t string")
    got = {(r.candidate, r.reference): (r.correlation, r.sha256_match) for r in X.contained_texts(X.text_sets(docs, "id", "t"), X.text_sets(refs, "id", "t"), 0.8).collect()}
    assert got == {(1, 7): (1.0, False), (3, 7): (1.0, True)}


def test_twenty_five_thousand_conditions(spark):
    from pixelstrata.functions.resampling import numbered
    from pixelstrata.operators import joins as J

    c = spark.range(25_000).select(F.col("id").alias("folder"), F.col("id").alias("slot"))
    assert numbered(c, "folder").agg(F.max("_i"), F.max("_n")).collect()[0][:] == (25_000, 25_000)
    items = spark.range(60_000).select(F.col("id").alias("p"))
    got = J.round_robin_assign(items, "p", c, "slot")
    assert got.count() == 60_000 and got.where("folder <> p % 25000").count() == 0


def test_decisions_compare_inside_each_reference(spark):
    from pixelstrata.operators.decisions import primary_checks, verdict

    def decide(drop):
        rows = [
            (ref, v, f, g, d) for ref, mine, fixed, lost in (("odd", 1.0, 0.5, 0.0), ("even", 3.0, 2.5, drop))
            for v, g, d in (("H-L", mine, 0.9 - lost), ("P-L", fixed, 0.5), ("P-H", 0.1, 0.91)) for f in range(10)]
        one, checks = primary_checks(spark.createDataFrame(rows, "reference string, variant string, folder long, g double, gradient double"), "H-L", ["P-L", "P-H"], max_drop=0.02)
        r = verdict(one, checks, ["advantage", "sign_agreement"]).collect()[0]
        return r.status, r.failed

    assert decide(0.0) == ("GO", "")
    assert decide(0.05) == ("PARTIAL", "gradient")  # one reference is enough


def test_lofo_select_kinds_of_rules(spark):
    """Against the definition: quantiles of the training conditions, gains blended by the weight."""
    r = np.random.default_rng(5)
    f = pd.DataFrame({"folder": range(7), "m": r.normal(size=7), "h": r.normal(size=7), "l": r.normal(size=7)})
    got = I.lofo_select(spark.createDataFrame(f), "m", "h", "l", [0.25, 0.5], [(0.0, 1.0)]).toPandas()
    assert sorted(got.groupby("heldout").kind.apply(sorted).map(tuple)) == [("constant", "hard", "linear")] * 7
    for x in got.itertuples():
        t, own = f[f.folder != x.heldout], f[f.folder == x.heldout].iloc[0]
        weights = {
            "hard_q25": lambda m: (m >= np.quantile(t.m, 0.25)) * 1.0, "hard_q50": lambda m: (m >= np.quantile(t.m, 0.5)) * 1.0,
            "linear_q00_q100": lambda m: np.clip((m - t.m.min()) / (t.m.max() - t.m.min()), 0, 1), "always_high": lambda m: m * 0 + 1, "always_low": lambda m: m * 0}
        gains = {k: (w(t.m) * t.h + (1 - w(t.m)) * t.l).mean() for k, w in weights.items()}
        rivals = [k for k in weights if k.split("_")[0] == x.kind or x.kind == "constant" and k.startswith("always")]
        assert x.candidate == max(rivals, key=gains.get) and x.train_gain == pytest.approx(gains[x.candidate])
        w = weights[x.candidate](own.m)
        assert (x.high_weight, x.heldout_gain) == (pytest.approx(w), pytest.approx(w * own.h + (1 - w) * own.l))


def test_grid_is_counted_without_being_made(spark):
    from pixelstrata.operators import joins

    n = 2000
    df = spark.createDataFrame([(k, k, k, str(k)) for k in range(n)] + [(0, 0, 0, "0"), (0, 0, None, "0")], "a int, b int, c int, d string")
    assert tuple(joins.grid_completeness(df, ["a", "b", "c", "d"]).first()) == (n**4, n + 1, n**4 - n, 1)
    assert tuple(joins.grid_completeness(df.limit(0), ["a", "b"]).first()) == (0, 0, 0, 0)


def test_curves_with_empty_bins_and_distances_on_them(spark):
    from pixelstrata.operators import mismatch as X

    rows = spark.createDataFrame([("g", 0, 2.0), ("g", 3, 8.0)], "k string, bin long, v double")
    groups = spark.createDataFrame([("g",), ("none",)], "k string")
    got = {(r.k, r.bin): (r.normalized, r.valid_fraction) for r in I.normalized_curve(rows, groups, ["k"], "v", 5).collect()}
    filled = np.array([2.0, 4.0, 6.0, 8.0, 8.0])
    for b, v in enumerate(filled / filled.mean()):
        assert got[("g", b)] == (pytest.approx(v), pytest.approx(0.4))
    assert got[("none", 0)] == (None, 0.0)

    def described(key, name, s, k, shares, curve):
        return X.Description(
            spark.createDataFrame([(name, "A", s, k)], f"{key} string, half string, s double, k double"),
            spark.createDataFrame([(name, "A", i + 1, v) for i, v in enumerate(shares)], f"{key} string, half string, radius long, share double"),
            spark.createDataFrame([(name, "A", i, v, 0.75) for i, v in enumerate(curve)], f"{key} string, half string, bin long, normalized double, valid_fraction double"))

    m = X.mismatch_metrics(described("folder", "f", 2.0, 1.0, [0.5, 0.5], [1.0, 1.0]), described("variant", "v", 1.0, 0.25, [0.25, 0.75], [0.5, 1.5])).collect()
    assert len(m) == 1 and (m[0].strength, m[0].tail, m[0].spatial, m[0].signal_nonstationarity) == pytest.approx((math.log(2), 0.75, 0.25, 0.5))
    assert (m[0].real_valid_fraction, m[0].synthetic_valid_fraction) == (0.75, 0.75)


def test_signal_bins_of_images_are_averaged_where_they_have_pixels(spark):
    from pixelstrata.operators import mismatch as X

    rows = [("v", 1, float(x), float(10 * x)) for x in range(8)] + [("v", 2, 5.0, 7.0)] * 4  # the second image has one level only
    got = {r.bin: r for r in X.binned_by_signal(spark.createDataFrame(rows, "k string, image long, x double, v double"), ["k"], ["image"], "x", "v", 4).collect()}
    raw = np.array([5.0, 25.0, 45.0, (65.0 + 7.0) / 2])
    assert [got[b].normalized for b in range(4)] == pytest.approx(list(raw / raw.mean())) and got[0].valid_fraction == 1.0


def test_mismatch_of_pairs_needs_no_pixel_rows(spark, monkeypatch):
    """F7, F8, F9: outputs stay tiles; frames of one or of several tiles give what pixel rows give."""
    from pixelstrata.operators import mismatch as X, pairs as Q
    from pixelstrata.operators.frames import explode_tiles
    from pixelstrata.operators.tiles import PLACE, frame_shape
    from pixelstrata.plans import QUERIES
    from pixelstrata.plans.views import Tables

    rng = np.random.default_rng(3)
    for cut in (6, 4):  # one tile, or one of 4 rows and one of 2
        frames = {(k, f): rng.integers(0, 60000, (6, 4)) for k in (1, 2) for f in range(1, 8)}
        rows = [(k, f, top, 0, h, 4, a[top:top + h].ravel().tolist()) for (k, f), a in frames.items() for top, h in ((0, cut), (cut, 6 - cut)) if h]
        tiles = spark.createDataFrame(rows, "folder bigint, frame bigint, top int, left int, h int, w int, dn array<bigint>")
        pairs = Q.odd_even_pairs(explode_tiles(tiles)).withColumn("r", (F.col("noisy") - F.col("clean")) / 65535.0)
        pixels = X.frame_centred(pairs, ["pair_key"])
        noisy, clean = Q.odd_even_tiles(tiles)
        labels = X.signal_bins(clean, "clean", 4)
        made = noisy.join(labels, ["folder", "top", "left"]).withColumn("_r", F.zip_with("noisy", "clean", lambda a, b: (a - b) / 65535.0))
        shape = frame_shape(tiles)
        got = X.frame_centred_tiles(made, ["folder", "frame", *PLACE], ["folder", "frame"], shape)
        want = {tuple(r)[:4]: r.r for r in pixels.select("folder", "frame", "y", "x", "r").collect()}
        found = {tuple(r)[:4]: r.r for r in explode_tiles(got, value="r").select("folder", "frame", "y", "x", "r").collect()}
        assert len(want) == 2 * 3 * 24 and found == pytest.approx(want)
        curve = X.binned_by_signal(pixels.withColumn("rr", F.col("r") * F.col("r")), ["folder"], ["pair_key"], "clean", "rr", 4)
        tiled = X.binned_by_map(got, labels, ["folder"], ["frame"], 4, shape)
        values = lambda d: {(r.folder, r.bin): r.normalized for r in d.collect()}
        assert len(values(curve)) == 8 and values(tiled) == pytest.approx(values(curve))

    def pixel_rows(self):
        raise AssertionError("pixel rows of predictions")

    monkeypatch.setattr(Tables, "predictions", pixel_rows)
    assert QUERIES["mismatch_metrics"](spark, "/root/testdata/sf0.001").columns[:3] == ["folder", "variant", "half"]


DECOUPLED = {"std": 0.02, "mean": 0.01, "clip": 0.001, "psd_cosine": 0.99, "autocorr_rmse": 0.02, "psd_l1": 0.1, "signal_correlation": 0.1, "skew": 0.2, "kurtosis": 0.2, "tail": 0.01}


def decoupled(spark, **change):
    """Checks of four variants that pass, after a change of {(variant, field): value} or of a curve."""
    base = {"std": 1.0, "target_error": 0.01, "mean_low": -0.001, "mean_high": 0.002, "clip": 0.0, "signal_correlation": 0.0, "skew": 0.0, "kurtosis": 0.0, "tail": 0.003}
    rows = {v: {**base, "std": 1.0 if v[-1] == "L" else 2.0, "skew": 0.5 if v[0] == "H" else 0.0} for v in ("P-L", "P-H", "H-L", "H-H")}
    psd = {v: [0.4, 0.3, 0.2, 0.1] for v in rows} | change.pop("psd", {})
    acf = {v: [1.0, 0.2, 0.0] for v in rows} | change.pop("acf", {})
    for (v, k), x in change.pop("at", {}).items():
        rows[v][k] = x
    names = list(base)
    s = spark.createDataFrame([(v, *[r[k] for k in names]) for v, r in rows.items()], "variant string, " + ", ".join(f"{k} double" for k in names))
    p = spark.createDataFrame([(v, i, x) for v, c in psd.items() for i, x in enumerate(c)], "variant string, radius long, value double")
    a = spark.createDataFrame([(v, 0, i, x) for v, c in acf.items() for i, x in enumerate(c)], "variant string, dy long, dx long, value double")
    got = P.decoupling_checks(s, p, a, ["P-L", "P-H", "H-L", "H-H"], DECOUPLED).collect()
    assert len(got) == 12 and len({r.decision for r in got}) == 1
    return got[0].decision, {r.check for r in got if not r.passed}


@pytest.mark.parametrize("change,failed", [
    ({}, set()),
    ({"at": {("H-L", "std"): 1.1}}, {"low_strength_matched"}),
    ({"at": {("P-H", "target_error"): 0.03}}, {"target_std_realized"}),
    ({"at": {("P-H", "mean_low"): -0.02}}, {"residual_mean_controlled"}),
    ({"at": {("H-H", "clip"): 0.01}}, {"clipping_controlled"}),
    ({"at": {("H-H", "clip"): None}}, {"clipping_controlled"}),
    ({"at": {("H-L", "skew"): 0.1}}, {"low_structure_distinct"}),
    ({"at": {("H-L", "skew"): None}}, {"low_structure_distinct"}),
    ({"psd": {"P-H": [0.1, 0.2, 0.3, 0.4]}}, {"first_scale_only_psd"}),
    ({"psd": {"P-H": [float("nan"), 0.3, 0.2, None]}}, set()),  # the common bins agree
    ({"psd": {"P-H": [None] * 4}}, {"first_scale_only_psd"}),
    ({"acf": {"H-H": [1.0, 0.3, 0.0]}}, {"second_scale_only_autocorr"}),
])
def test_twelve_decoupling_checks(spark, change, failed):
    decision, got = decoupled(spark, **{k: dict(v) for k, v in change.items()})
    assert got == failed and decision == ("STOP" if failed else "GO")


def test_curve_distances_on_common_bins(spark):
    rows = [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, None), ("b", 0, 2.0), ("b", 1, float("nan")), ("b", 3, 1.0)]
    d = spark.createDataFrame(rows, "variant string, i long, value double")
    r = P.curve_distances(d, ["i"], {"ab": ("a", "b"), "aa": ("a", "a")}).collect()
    got = {x.pair: x for x in r}
    assert (got["ab"].cosine, got["ab"].l1, got["ab"].rmse, got["ab"].valid_fraction) == pytest.approx((1.0, 1.0, 1.0, 0.25))
    assert (got["aa"].cosine, got["aa"].l1) == pytest.approx((1.0, 0.0))


def test_shingle_counts_grow_with_the_input_and_fit_a_byte(spark):
    from pixelstrata.operators import text_similarity as X

    rows = [(1, "a b c d e"), (2, "a b c"), (3, None)] + [(10 + k, "x y z") for k in range(200)]
    counts = X.bucket_counts(X.text_sets(spark.createDataFrame(rows, "id long, t string"), "id", "t"))
    assert counts.dtype == np.uint8 and len(counts) == 1 << 16  # not the full table for a small input
    assert sorted(counts[counts > 0].tolist()) == [1, 1, 2, 127 + int(8 * np.log2(200 / 127))]


def test_strict_clusters_need_only_members_of_lenient_ones(spark):
    from pixelstrata.operators import similarity as M, text_similarity as X

    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[:-1] + ["end"]), " ".join(words[:-1] + ["end"]), "quite another text of its own"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sets = X.text_sets(frame, "id", "t")
    lenient = M.connected_components(frame.select("id"), X.linked_texts(sets, 0.8))
    few = X.within_clusters(sets, lenient)
    assert sorted(r.id for r in few.collect()) == [0, 1, 2]
    by = lambda s: {r.id: r.component for r in M.connected_components(frame.select("id"), X.linked_texts(s, 0.9)).collect()}
    assert by(few) == by(sets) == {0: 0, 1: 0, 2: 0, 3: 3}


def test_hash_of_a_text_is_that_of_its_profile_image_and_few_are_held(spark, monkeypatch):
    monkeypatch.setattr(M, "HASHED", 2)
    rows = [(1, "some text"), (2, None), (3, ""), (4, "é¤ 漢字"), (5, "other words, and more"), (6, "x" * 5000)]
    texts = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    want = {r.id: r.phash for r in M.perceptual_hash(M.character_profile(texts, "id", "t", 1024), ["id"], "vec", 32).collect()}
    assert {r.id: r.phash for r in M.text_hash(texts, "id", "t", 32).collect()} == want and len(want) == 6


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_frames_of_one_image_a_key_need_no_shuffle_for_their_power(spark, stack):
    h, w = stack.shape[1:]
    tiles = tiles_of(spark, stack, 100).withColumnRenamed("frame", "image").select("*", F.lit(0).alias("frame"), F.col("dn").cast("array<double>").alias("r"))
    for given in ({}, {"hann": True}, {"pad": 2}):
        whole, parts = (S.power_blocks(tiles, ["image"], shape=L.Shape(h, w, h, 0, k), **given) for k in (True, False))
        assert "Exchange" not in plan_of(whole) and whole.dtypes == parts.dtypes
        of = lambda d: {r.image: (r.c0, r.c, r.n, r.h, r.w, pytest.approx(r.total)) for r in d.collect()}
        assert of(whole) == {r.image: (r.c0, r.c, r.n, r.h, r.w, r.total) for r in parts.collect()}


@pytest.mark.parametrize("border,fn,names", [("nan", L.box(1), ["local_mean", "local_std"]), ("edge", L.box(1), ["local_mean"]), ("reflect", L.blur([(-1, 0.25), (0, 0.5), (1, 0.25)]), ["low", "hp"])])
def test_stencils_on_whole_frames_stay_in_their_task(spark, stack, border, fn, names):
    h, w = stack.shape[1:]
    tiles, keys = tiles_of(spark, stack, 100), ["folder", "frame"]
    whole, parts = (L.stencil(tiles, keys, "dn", 1, L.Shape(h, w, h, len(stack), k), fn, names, border) for k in (True, False))
    assert "Exchange" not in plan_of(whole) and whole.dtypes == parts.dtypes
    of = lambda d: {tuple(r)[:6]: [list(x) for x in tuple(r)[6:]] for r in d.collect()}
    assert of(whole) == of(parts)


def test_quantiles_of_few_keys_move_no_row_before_it_is_counted(spark):
    from pixelstrata.functions.ordering import exact_quantiles

    d = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 101).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = (exact_quantiles(d, "k", "v", {"a": 0.5, "b": 0.9}, few=f) for f in (True, False))
        assert "SortMergeJoin" not in plan_of(few) and "SortMergeJoin" in plan_of(many)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_log_lines_are_parsed_once(spark):
    from pixelstrata.sources.listings import acquisition_log

    lines = spark.range(3).select("id", F.concat(F.col("id").cast("string"), F.lit("-Camera1.tif Exposure delay:0ms, width:5ms Sync.A delay:0ns, width:4us Sync.B delay:0ns, width:4us gain 3")).alias("line"))
    d = acquisition_log(lines, ["id"])
    assert [r.gain for r in d.collect()] == [3.0] * 3
    assert d._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_near_text_queries_store_no_shingle_sets(spark, monkeypatch):
    """sets are formed in each pass over the texts; the links are those of stored sets."""
    from pixelstrata.operators import text_similarity as X
    from pixelstrata.plans import QUERIES

    stored, hold = [], X.cut_lineage
    monkeypatch.setattr(X, "cut_lineage", lambda df: stored.append(df.columns) or hold(df))
    rng = np.random.default_rng(5)
    base = [list(rng.integers(0, 500, 40)) for _ in range(12)]
    texts = [" ".join(f"w{v}" for v in (b[:-1] + [900 + k] if k else b)) for b in base for k in range(3)] + [None, "", "two words", "two words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    links = lambda d: {tuple(r) for r in d.collect()}
    found, linked = links(X.similar_texts(X.Texts(rows), 0.8)), links(X.linked_texts(X.Texts(rows), 0.8))
    assert QUERIES["cross_split_edges"](spark, "/root/testdata/sf0.001").columns == ["a", "b", "corr", "split_a", "split_b"]
    assert stored and not any("shingles" in c for c in stored)
    sets = X.text_sets(rows, "id", "text")
    assert len(found) > 20 and found == links(X.similar_texts(sets, 0.8)) and linked == links(X.linked_texts(sets, 0.8))
