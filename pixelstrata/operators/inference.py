"""Statistics over condition, strategy and factorial tables.

Pair-level tables are reduced by partial aggregation first; windows and pairings
only ever see one row per condition, cell or strategy.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelstrata.functions.ordering import average_rank, exact_quantiles
from pixelstrata.functions.resampling import bootstrap_interval, hash_index, keyed_permutations, numbered, paired, share_interval
from pixelstrata.functions.scalars import corr_agg, corr_from_moments, dbl, finite, ratio, safe_div

T_CRITICAL_DF2 = 4.3026527297  # two-sided 95 % Student t, two degrees of freedom


def positive_share(c: str) -> Column:
    return F.avg((F.col(c) > 0).cast("double"))


# -- correlations ------------------------------------------------------------

def rank_corr(df: DataFrame, keys: list[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """Spearman correlation per group of a condition-level table."""
    r = average_rank(average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, "_rx"), keys, y, "_ry")
    return r.groupBy(*keys).agg(corr_agg("_rx", "_ry").alias(name), F.count(F.lit(1)).alias("n"))


def corr_matrix(df: DataFrame, features: list[str], redundant: float = 0.8) -> DataFrame:
    """Pearson and Spearman for every feature pair in one aggregation."""
    d = df
    for f in features:
        d = average_rank(d, [], f, f"_r_{f}")
    cells = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), corr_agg(a, b).alias("pearson"),
                 corr_agg(f"_r_{a}", f"_r_{b}").alias("spearman"))
        for a, b in itertools.combinations(features, 2)]
    return d.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("c")).select("c.*").withColumn(
        "redundant", F.coalesce(F.greatest(F.abs("pearson"), F.abs("spearman")) >= redundant, F.lit(False)))


def _corr_row(df: DataFrame, features: list[str]) -> DataFrame:
    return df.agg(F.array(*[corr_agg(a, b) for a in features for b in features]).alias("m"))


def vif(df: DataFrame, features: list[str]) -> DataFrame:
    """Variance inflation factors: diagonal of the inverse correlation matrix."""
    import numpy as np
    import pandas as pd

    k = len(features)

    def solve(batches):
        for pdf in batches:
            for m in pdf["m"]:
                inv = np.linalg.pinv(np.asarray(m, dtype=float).reshape(k, k))
                yield pd.DataFrame({"feature": features, "vif": np.diag(inv)})

    return _corr_row(df, features).mapInPandas(solve, "feature string, vif double")


def pca_variance(df: DataFrame, features: list[str]) -> DataFrame:
    """Explained shares and loadings of the standardised features (largest loading positive)."""
    import numpy as np
    import pandas as pd

    k = len(features)

    def solve(batches):
        for pdf in batches:
            for m in pdf["m"]:
                val, vec = np.linalg.eigh(np.asarray(m, dtype=float).reshape(k, k))
                order = np.argsort(val)[::-1]
                val, vec = val[order], vec[:, order]
                vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), range(k)])
                yield pd.DataFrame({
                    "component": np.repeat(np.arange(1, k + 1), k), "feature": features * k,
                    "explained": np.repeat(val / val.sum(), k), "loading": vec.T.ravel()})

    return _corr_row(df, features).mapInPandas(solve, "component long, feature string, explained double, loading double")


def confound_table(df: DataFrame, signal: str, features: list[str], high: float = 0.8) -> DataFrame:
    """Spearman of each feature with the signal, its range, HIGH when strongly tied."""
    d = average_rank(df, [], signal, "_rs")
    for f in features:
        d = average_rank(d, [], f, f"_r_{f}")
    cells = [F.struct(F.lit(f).alias("feature"), corr_agg("_rs", f"_r_{f}").alias("spearman"), F.min(dbl(f)).alias("min"),
                      F.max(dbl(f)).alias("max"), safe_div(F.max(f) - F.min(f), F.avg(f)).alias("relative_range")) for f in features]
    return d.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("c")).select("c.*").withColumn(
        "confound", F.when(F.abs("spearman") >= high, "HIGH").otherwise("LOW"))


def strength_repeatability(df: DataFrame, counts: list[int]) -> DataFrame:
    """Spread of a per-folder metric over frame counts and the worst agreement of folder order.

    Input: (folder, frames, v).
    """
    wide = df.groupBy("folder").agg(
        F.min("v").alias("strength_min"), F.max("v").alias("strength_max"), safe_div(F.stddev_samp("v"), F.avg("v")).alias("strength_cv"),
        safe_div(F.max("v") - F.min("v"), F.avg("v")).alias("relative_range"),
        *[F.max(F.when(F.col("frames") == c, F.col("v"))).alias(f"_v{c}") for c in counts])
    for c in counts:
        wide = average_rank(wide, [], f"_v{c}", f"_r{c}")
    w = W.partitionBy(F.lit(1))
    rhos = [corr_from_moments(F.covar_pop(f"_r{a}", f"_r{b}").over(w), F.var_pop(f"_r{a}").over(w), F.var_pop(f"_r{b}").over(w))
            for a, b in itertools.combinations(counts, 2)]
    return wide.withColumn("min_order_correlation", F.least(*rhos)).select(
        "folder", "strength_min", "strength_max", "strength_cv", "relative_range", "min_order_correlation")


def conditional_curve(df: DataFrame, keys: list[str], signal: str, residual: Column, bins: int) -> DataFrame:
    """Residual mean and variance per signal quantile bin; variance curve interpolated over gaps and normalised."""
    d = df.withColumn("_r", residual)
    edges = d.groupBy(*keys).agg(F.percentile(signal, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_e"))
    label = sum(((F.col(signal) >= F.element_at("_e", i)).cast("bigint") for i in range(1, bins)), F.lit(0).cast("bigint"))
    a = d.join(edges, keys).groupBy(*keys, label.alias("bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_r").alias("residual_mean"), F.var_pop("_r").alias("residual_var"))
    f = normalized_curve(a, d.select(*keys).distinct(), keys, "residual_var", bins)
    return f.select(*keys, "bin", F.coalesce("_n", F.lit(0).cast("bigint")).alias("count"), "residual_mean", "residual_var", F.col("normalized").alias("normalized_var"), "valid_fraction")


def normalized_curve(rows: DataFrame, groups: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """The columns of ``rows`` for all bins of all groups, with ``normalized`` and ``valid_fraction``.

    Bins without a value get one on the line between their neighbours, or the nearest value at
    the ends; the curve is divided by its mean absolute value. A group without any value has a
    null curve and a valid fraction of 0.
    """
    full = groups.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    f = full.join(rows, [*keys, "bin"], "left")
    w = W.partitionBy(*keys).orderBy("bin")
    prev, nxt = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct("bin", F.col(value).alias("v")))
    f = f.withColumn("_p", F.last(known, True).over(prev)).withColumn("_q", F.first(known, True).over(nxt))
    line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * F.try_divide(F.col("bin") - F.col("_p.bin"), F.col("_q.bin") - F.col("_p.bin"))
    f = f.withColumn("_filled", F.coalesce(value, line, F.col("_p.v"), F.col("_q.v")))
    g = W.partitionBy(*keys)
    return f.withColumn("normalized", F.col("_filled") / F.greatest(F.avg(F.abs("_filled")).over(g), F.lit(1e-12))).withColumn(
        "valid_fraction", F.count(value).over(g) / F.lit(float(bins))).drop("_p", "_q", "_filled")


# -- fits ----------------------------------------------------------------------

FIT_MODELS = ["std_linear", "var_linear", "log_log", "std_nonnegative", "var_zero_intercept"]


def fit_coefficients(n, sx, sy, sxx, sxy, model: str) -> tuple[Column, Column]:
    """(a, b) of y = a + b x from moment sums, for the constrained and unconstrained forms."""
    den = n * sxx - sx * sx
    b_free = F.try_divide(n * sxy - sx * sy, den)
    a_free = F.try_divide(sy - b_free * sx, n)
    b_zero = F.try_divide(sxy, sxx)
    if model == "var_zero_intercept":
        return F.lit(0.0), b_zero
    if model == "std_nonnegative":
        # two-variable non-negative least squares: interior, on a = 0, or on b = 0
        inside = (a_free >= 0) & (b_free >= 0)
        mean = F.try_divide(sy, n)
        on_a, on_b = F.greatest(b_zero, F.lit(0.0)), F.greatest(mean, F.lit(0.0))
        sse_a = -2 * on_a * sxy + on_a * on_a * sxx
        sse_b = -2 * on_b * sy + n * on_b * on_b
        return (F.when(inside, a_free).when(sse_a <= sse_b, F.lit(0.0)).otherwise(on_b),
                F.when(inside, b_free).when(sse_a <= sse_b, on_a).otherwise(F.lit(0.0)))
    return a_free, b_free


def fit_axes(model: str) -> tuple[Column, Column]:
    """x and y of a model in terms of the columns x (signal) and s (noise std)."""
    x, s = F.col("x"), F.col("s")
    if model == "log_log":
        return F.log(x), F.log(s)
    if model.startswith("var"):
        return x, s * s
    return x, s


def fit_predict(model: str, a: Column, b: Column, x: Column) -> Column:
    """Predicted noise std."""
    if model == "log_log":
        return F.exp(a + b * F.log(x))
    if model.startswith("var"):
        return F.sqrt(F.greatest(a + b * x, F.lit(0.0)))
    return a + b * x


def _moments(model: str) -> list[Column]:
    x, y = fit_axes(model)
    return [F.sum(e).alias(f"{model}_{k}") for k, e in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y), ("syy", y * y))]


def signal_noise_fit(df: DataFrame, signal: str, noise: str, models: list[str] = FIT_MODELS) -> DataFrame:
    """Noise against signal in several models: coefficients, native R2, RMSE in std, plausibility."""
    d = df.select(dbl(signal).alias("x"), dbl(noise).alias("s")).where((F.col("x") > 0) & (F.col("s") > 0))
    tot = d.agg(F.count(F.lit(1)).cast("double").alias("n"), *[m for k in models for m in _moments(k)])
    rows = []
    for k in models:
        g = {p: F.col(f"{k}_{p}") for p in ("sx", "sy", "sxx", "sxy", "syy")}
        a, b = fit_coefficients(F.col("n"), g["sx"], g["sy"], g["sxx"], g["sxy"], k)
        rows.append(F.struct(F.lit(k).alias("model"), a.alias("a"), b.alias("b")))
    coef = tot.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    # one row per model joined to the data through an exploded model name
    e = d.withColumn("model", F.explode(F.array(*[F.lit(k) for k in models]))).join(F.broadcast(coef), "model")
    pick = lambda fn: F.coalesce(*[F.when(F.col("model") == k, fn(k)) for k in models])
    e = e.withColumn("p", pick(lambda k: fit_predict(k, F.col("a"), F.col("b"), F.col("x")))).withColumn(
        "y", pick(lambda k: fit_axes(k)[1])).withColumn("yp", pick(lambda k: F.col("a") + F.col("b") * fit_axes(k)[0]))
    g = e.groupBy("model", "a", "b").agg(
        (1 - safe_div(F.sum((F.col("y") - F.col("yp")) ** 2), F.var_pop("y") * F.count(F.lit(1)))).alias("r2"),
        F.sqrt(F.avg((F.col("s") - F.col("p")) ** 2)).alias("rmse"), F.min("p").alias("_pmin"))
    return g.withColumn("nonphysical", (F.col("model").isin("std_linear", "var_linear") & (F.col("a") < 0)) | (F.col("_pmin") <= 0)).drop("_pmin")


def loo_fit(df: DataFrame, key: str, signal: str, noise: str, models: list[str] = FIT_MODELS) -> DataFrame:
    """Refits without each condition: total minus own moments, so the pass stays linear."""
    d = df.select(key, dbl(signal).alias("x"), dbl(noise).alias("s")).where((F.col("x") > 0) & (F.col("s") > 0))
    w = W.partitionBy(F.lit(1))
    cols = {}
    for k in models:
        x, y = fit_axes(k)
        for p, e in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y)):
            cols[(k, p)] = (F.sum(e).over(w), e)
    n = F.count(F.lit(1)).over(w).cast("double")
    rows = []
    for k in models:
        t = [cols[(k, p)] for p in ("sx", "sy", "sxx", "sxy")]
        a, b = fit_coefficients(n - 1, *[tot - own for tot, own in t], k)
        fa, fb = fit_coefficients(n, *[tot for tot, _ in t], k)
        rows.append(F.struct(F.lit(k).alias("model"), a.alias("a"), b.alias("b"), fb.alias("full_b")))
    e = d.select(key, "x", "s", F.array(*rows).alias("r")).select(key, "x", "s", F.explode("r").alias("c")).select(key, "x", "s", "c.*")
    pred = F.coalesce(*[F.when(F.col("model") == k, fit_predict(k, F.col("a"), F.col("b"), F.col("x"))) for k in models])
    return e.withColumn("predicted", pred).withColumn("error", F.col("s") - F.col("predicted")).withColumn(
        "slope_change", F.abs(F.col("b") - F.col("full_b")) / F.greatest(F.abs("full_b"), F.lit(1e-12)))


def loo_summary(loo: DataFrame) -> DataFrame:
    """Held-out RMSE, MAE, slope stability and rank per model."""
    g = loo.groupBy("model").agg(
        F.sqrt(F.avg(F.col("error") ** 2)).alias("loo_rmse"), F.avg(F.abs("error")).alias("loo_mae"),
        F.avg((F.sign("b") == F.sign("full_b")).cast("double")).alias("sign_consistency"), F.max("slope_change").alias("max_slope_change"))
    return g.withColumn("model_rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.round("loo_rmse", 6), "model")).cast("bigint"))


def brightness_adjust(df: DataFrame, key: str, signal: str, value: str) -> DataFrame:
    """Residual of a statistic after a straight line in the signal: standardised, ranked, signed."""
    w = W.partitionBy(F.lit(1))
    x, y = dbl(signal), dbl(value)
    d = df.select(key, (y - (F.regr_intercept(y, x).over(w) + F.regr_slope(y, x).over(w) * x)).alias("adjusted"))
    d = average_rank(d.withColumn("_k", F.round("adjusted", 6)), [], "_k", "adjusted_rank").drop("_k")
    return d.withColumn("standardized", ratio(F.col("adjusted"), F.stddev_samp("adjusted").over(w))).withColumn(
        "direction", F.sign("adjusted").cast("bigint"))


def ols_fit(df: DataFrame, keys: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """Least squares on two regressors per group, in closed form from centred moments."""
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.var_pop(dbl(x1)).alias("v1"),
        F.var_pop(dbl(x2)).alias("v2"), F.covar_pop(dbl(x1), dbl(x2)).alias("c12"), F.covar_pop(dbl(x1), dbl(y)).alias("c1"),
        F.covar_pop(dbl(x2), dbl(y)).alias("c2"), F.var_pop(dbl(y)).alias("vy"))
    c = F.col
    det = c("v1") * c("v2") - c("c12") * c("c12")
    g = g.withColumn("b1", F.try_divide(c("c1") * c("v2") - c("c2") * c("c12"), det)).withColumn(
        "b2", F.try_divide(c("c2") * c("v1") - c("c1") * c("c12"), det))
    explained = c("b1") * c("c1") + c("b2") * c("c2")
    return g.select(
        *keys, "n", (c("my") - c("b1") * c("m1") - c("b2") * c("m2")).alias("intercept"), "b1", "b2",
        ratio(explained, c("vy")).alias("r2"), F.sqrt(F.greatest(c("vy") - explained, F.lit(0.0))).alias("residual_std"))


def ols_one_hot(df: DataFrame, factors: list[str], y: str) -> DataFrame:
    """Additive factor model (one-hot, first level as reference): coefficients via normal equations.

    Only the level-by-level count and sum tables leave Spark's aggregation.
    """
    import numpy as np
    import pandas as pd

    cells = df.groupBy(*factors).agg(F.count(F.lit(1)).alias("_n"), F.sum(dbl(y)).alias("_s"), F.sum(dbl(y) * dbl(y)).alias("_q"))
    packed = cells.groupBy().agg(F.collect_list(F.struct(*[F.col(f).cast("string").alias(f) for f in factors], "_n", "_s", "_q")).alias("cells"))

    def solve(batches):
        for pdf in batches:
            for cell in pdf["cells"]:
                c = pd.DataFrame([r.asDict() if hasattr(r, "asDict") else dict(r) for r in cell])
                names, cols = ["intercept"], [np.ones(len(c))]
                for f in factors:
                    for level in sorted(c[f].unique())[1:]:
                        names.append(f"{f}={level}")
                        cols.append((c[f] == level).to_numpy(float))
                X, n = np.column_stack(cols), c["_n"].to_numpy(float)
                beta = np.linalg.lstsq(X.T @ (X * n[:, None]), X.T @ c["_s"].to_numpy(), rcond=None)[0]
                total = c["_q"].sum() - c["_s"].sum() ** 2 / n.sum()
                sse = c["_q"].sum() - beta @ (X.T @ c["_s"].to_numpy())
                yield pd.DataFrame({"term": names, "coefficient": beta, "r2": 1 - sse / total if total > 0 else np.nan})

    return packed.mapInPandas(solve, "term string, coefficient double, r2 double")


def lofo_ridge(df: DataFrame, fold: str, y: str, features: list[str], alpha: float = 1.0) -> DataFrame:
    """Standardised ridge trained without each fold, against the training-mean null.

    Fold Gram sums come from one aggregation; training sums are total minus own.
    """
    import numpy as np
    import pandas as pd

    k = len(features)
    z = [F.lit(1.0), *[dbl(f) for f in features], dbl(y)]
    m = len(z)
    gram = df.groupBy(fold).agg(F.array(*[F.sum(z[i] * z[j]) for i in range(m) for j in range(m)]).alias("own"))
    w = W.partitionBy(F.lit(1))
    tot = F.array(*[F.sum(F.element_at("own", i + 1)).over(w) for i in range(m * m)])
    gram = gram.withColumn("total", tot)

    def solve(batches):
        for pdf in batches:
            out = []
            for key, own, total in zip(pdf[fold], pdf["own"], pdf["total"]):
                own = np.asarray(own).reshape(m, m)
                g = np.asarray(total).reshape(m, m) - own
                n = g[0, 0]
                mu, ym = g[0, 1:k + 1] / n, g[0, -1] / n
                cov = g[1:k + 1, 1:k + 1] / n - np.outer(mu, mu)
                sd = np.sqrt(np.maximum(np.diag(cov), 0))
                sd[sd <= 1e-12] = 1.0
                cy = g[1:k + 1, -1] / n - mu * ym
                beta = np.linalg.solve(n * cov / np.outer(sd, sd) + alpha * np.eye(k), n * cy / sd)
                # held-out squared error from the fold's own Gram sums
                t = np.concatenate([[ym - (beta / sd) @ mu], beta / sd, [-1.0]])
                null = np.concatenate([[ym], np.zeros(k), [-1.0]])
                c = own[0, 0]
                out.append((key, int(c), float(np.sqrt(max(t @ own @ t, 0) / c)), float(np.sqrt(max(null @ own @ null, 0) / c))))
            yield pd.DataFrame(out, columns=["heldout", "n", "ridge_rmse", "null_rmse"])

    return gram.mapInPandas(solve, "heldout long, n long, ridge_rmse double, null_rmse double").withColumn(
        "rmse_gain", F.col("null_rmse") - F.col("ridge_rmse"))


# -- strategies ----------------------------------------------------------------

def condition_score(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Mean of population z-scores of the metrics (zero spread counts as one)."""
    w = W.partitionBy(F.lit(1))
    zs = []
    for m in metrics:
        sd = F.stddev_pop(dbl(m)).over(w)
        zs.append((dbl(m) - F.avg(dbl(m)).over(w)) / F.when(sd > 0, sd).otherwise(F.lit(1.0)))
    d = df.select("*", *[z.alias(f"z_{m}") for m, z in zip(metrics, zs)])
    return d.withColumn("condition_score", sum((F.col(f"z_{m}") for m in metrics), F.lit(0.0)) / len(metrics))


def quantile_gates(cond: DataFrame, metrics: list[str], quantiles: list[float]) -> DataFrame:
    """Threshold strategies (name, metric, threshold) from condition quantiles."""
    q = cond.agg(*[F.percentile(m, F.array(*[F.lit(float(p)) for p in quantiles])).alias(m) for m in metrics])
    specs = [F.struct(F.lit(f"gate_{m}_q{int(round(p * 100)):02d}").alias("strategy"), F.lit(m).alias("metric"),
                      F.element_at(m, i + 1).alias("threshold")) for m in metrics for i, p in enumerate(quantiles)]
    return q.select(F.explode(F.array(*specs)).alias("s")).select("s.*")


def gate_decisions(cond: DataFrame, specs: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(folder, strategy, use_model): does the condition reach the strategy's threshold."""
    long = cond.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), dbl(m).alias("v")) for m in metrics])).alias("m"))
    return long.select(key, "m.metric", "m.v").join(F.broadcast(specs), "metric").select(
        key, "strategy", (F.col("v") >= F.col("threshold")).alias("use_model"))


def strategy_summary(df: DataFrame, strategy: str, folder: str, gain: str, ssim: str, source: str) -> DataFrame:
    """Pair, folder and source statistics per strategy."""
    by_folder = df.groupBy(strategy, folder).agg(
        F.count(F.lit(1)).alias("n"), F.sum(gain).alias("s"), F.sum(dbl(gain) * dbl(gain)).alias("q"), F.sum(ssim).alias("ss"),
        F.sum((F.col(gain) > 0).cast("bigint")).alias("p"))
    fg = by_folder.withColumn("g", dbl("s") / F.col("n"))
    n = dbl(F.sum("n"))
    base = fg.groupBy(strategy).agg(
        F.sum("n").alias("pair_count"), F.count(F.lit(1)).alias("folder_count"), (F.sum("s") / n).alias("mean_gain"),
        F.sqrt(F.greatest((F.sum("q") - F.sum("s") * F.sum("s") / n) / (n - 1), F.lit(0.0))).alias("std_gain"),
        (F.sum("p") / n).alias("positive_pair_fraction"), F.sum((F.col("g") > 0).cast("bigint")).alias("positive_folders"),
        F.sum((F.col("g") < 0).cast("bigint")).alias("negative_folders"), F.avg("g").alias("mean_folder_gain"),
        F.percentile("g", 0.5).alias("median_folder_gain"), (F.sum("ss") / n).alias("mean_ssim"))
    median = exact_quantiles(df, strategy, gain, {"median_gain": 0.5}, few=True)
    src = df.groupBy(strategy, source).agg(F.count(F.lit(1)).alias("n")).groupBy(strategy).agg(
        F.concat_ws(";", F.array_sort(F.collect_list(F.concat(F.col(source), F.lit(":"), F.col("n").cast("string"))))).alias("selected_sources"))
    return base.join(median, strategy).join(src, strategy)


def folder_gains(df: DataFrame, keys: list[str], gain: str = "psnr_gain") -> DataFrame:
    """Mean, min, max gain and positive share per key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(gain).alias("mean_gain"), F.min(gain).alias("min_gain"), F.max(gain).alias("max_gain"),
        positive_share(gain).alias("positive_fraction"))


def smoothing_risk(df: DataFrame, key: str, gradient: str, gain: str, order: list[str]) -> DataFrame:
    """How often sharpness drops below 0.95 / 0.85, how often gain hides it, and the worst row.

    ``gradient`` is a ratio in percent.
    """
    g = F.col(gradient)
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum((g < 95).cast("bigint")).alias("below_95"), F.sum((g < 85).cast("bigint")).alias("below_85"),
        F.sum(((g < 95) & (F.col(gain) > 0)).cast("bigint")).alias("below_95_gain_positive"),
        F.sum(((g < 85) & (F.col(gain) > 0)).cast("bigint")).alias("below_85_gain_positive"),
        F.min(F.struct(gradient, *order)).alias("_w")).select(
        key, "pairs", "below_95", "below_85", "below_95_gain_positive", "below_85_gain_positive",
        F.col(f"_w.{gradient}").alias("worst_gradient"), *[F.col(f"_w.{o}").alias(f"worst_{o}") for o in order])


def lofo_select(folders: DataFrame, metric: str, high: str, low: str, quantiles: list[float], ramps: list[tuple[float, float]]) -> DataFrame:
    """Per held-out condition and kind of rule: the best rule on the other conditions, then its outcome on the held-out one.

    A rule gives the weight of the high source by the metric. Hard rules switch at a quantile of the
    training conditions, linear ones ramp between two quantiles, constant ones always take one source.
    ``folders``: one row per condition (folder, metric, gain of each source).
    """
    pairs = paired(folders.select("folder", dbl(metric).alias("m"), dbl(high).alias("h"), dbl(low).alias("l")), "folder", unordered=False)
    tr = pairs.select(F.col("a.folder").alias("heldout"), F.col("a").alias("own"), F.col("b").alias("t"))
    levels = sorted({*quantiles, *(q for pair in ramps for q in pair)})
    q = tr.groupBy("heldout").agg(F.percentile("t.m", F.array(*[F.lit(float(x)) for x in levels])).alias("_q"))
    at = lambda x: F.element_at("_q", levels.index(x) + 1)
    name = lambda x: f"q{int(round(x * 100)):02d}"
    rule = lambda n, kind, lo, hi, w: F.struct(F.lit(n).alias("candidate"), F.lit(kind).alias("kind"), lo.alias("low"), hi.alias("high"), F.lit(w).cast("double").alias("fixed"))
    none = F.lit(None).cast("double")
    rules = [rule(f"hard_{name(x)}", "hard", at(x), at(x), None) for x in quantiles] + [rule(f"linear_{name(x)}_{name(y)}", "linear", at(x), at(y), None) for x, y in ramps]
    rules += [rule("always_high", "constant", none, none, 1.0), rule("always_low", "constant", none, none, 0.0)]
    cand = q.select("heldout", F.explode(F.array(*rules)).alias("c")).select("heldout", "c.*")

    def weight(m: Column) -> Column:
        ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (m - F.col("low")) / (F.col("high") - F.col("low"))))
        return F.coalesce("fixed", F.when(F.col("high") > F.col("low"), ramp).otherwise((m >= F.col("low")).cast("double")))

    gain = lambda c: weight(F.col(f"{c}.m")) * F.col(f"{c}.h") + (1 - weight(F.col(f"{c}.m"))) * F.col(f"{c}.l")
    key = ["heldout", "candidate", "kind", "low", "high", "fixed"]
    s = tr.join(cand, "heldout").withColumn("g", gain("t")).groupBy(*key).agg(
        F.avg("g").alias("train_gain"), F.sum((F.col("g") < 0).cast("bigint")).alias("negative_folders"), F.first("own").alias("own"))
    w = W.partitionBy("heldout", "kind").orderBy(F.round("train_gain", 9).desc(), "negative_folders", "candidate")
    best = s.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return best.select("heldout", "candidate", "kind", "low", "high", "train_gain", "negative_folders", weight(F.col("own.m")).alias("high_weight"), gain("own").alias("heldout_gain"))


def leave_one_out_moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and std of everything except each condition: total minus own, one pass."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(dbl(value)).alias("s"), F.sum(dbl(value) * dbl(value)).alias("q"))
    w = W.partitionBy(F.lit(1))
    rest = {c: F.sum(c).over(w) - F.col(c) for c in ("n", "s", "q")}
    return g.select(
        F.col(key).alias("heldout"), rest["n"].alias("train_rows"), ratio(rest["s"], rest["n"]).alias("train_mean"),
        F.sqrt(F.greatest(ratio(rest["q"], rest["n"]) - ratio(rest["s"], rest["n"]) ** 2, F.lit(0.0))).alias("train_std"),
        F.col("n").alias("heldout_rows"), (F.col("s") / F.col("n")).alias("heldout_mean"))


def paired_contrasts(cells: DataFrame, reference: str, strategy: str, folder: str, value: str, primary: str,
                     rounds: int, seed: int) -> DataFrame:
    """Primary minus every comparator per folder, with bootstrap interval and sign counts."""
    p = cells.where(F.col(strategy) == primary).select(reference, folder, F.col(value).alias("_p"))
    d = cells.where(F.col(strategy) != primary).join(p, [reference, folder]).select(
        reference, F.col(strategy).alias("comparator"), folder, (F.col("_p") - F.col(value)).alias("d"))
    key = [reference, "comparator"]
    s = d.groupBy(*key).agg(
        F.avg("d").alias("mean_difference"), F.sum((F.col("d") > 1e-12).cast("bigint")).alias("better"),
        F.sum((F.abs("d") <= 1e-12).cast("bigint")).alias("equal"), F.sum((F.col("d") < -1e-12).cast("bigint")).alias("worse"),
        F.min("d").alias("min_difference"), F.max("d").alias("max_difference"))
    return s.join(bootstrap_interval(d, key, folder, "d", rounds, seed), key)


def reference_agreement(cells: DataFrame, strategy: str, folder: str, reference: str, value: str, pair: tuple[str, str]) -> DataFrame:
    """Agreement of two independent references per strategy."""
    a, b = (F.max(F.when(F.col(reference) == r, F.col(value))) for r in pair)
    w = cells.groupBy(strategy, folder).agg(a.alias("a"), b.alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    return w.groupBy(strategy).agg(
        F.avg((F.sign("a") == F.sign("b")).cast("double")).alias("sign_agreement"), F.avg(d).alias("mean_abs_delta"),
        F.max(d).alias("max_abs_delta"), corr_agg("a", "b").alias("correlation"))


def reference_stability(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Spread of a gain over references and the share with the majority sign."""
    up, down = F.avg((F.col(value) >= 0).cast("double")), F.avg((F.col(value) <= 0).cast("double"))
    return cells.groupBy(*keys).agg(
        F.avg(value).alias("mean_gain"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_gain"),
        (F.max(value) - F.min(value)).alias("range_gain"), F.greatest(up, down).alias("sign_share"))


# -- factorial -------------------------------------------------------------------

CELL = ["variant", "seed", "reference", "folder"]
FIELDS = ["psnr_gain", "ssim", "gradient_ratio", "residual_std", "brightness_bias"]
VARIANTS = ["P-L", "P-H", "H-L", "H-H"]


def factorial_folders(rows: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Mean of every field over the pairs of a cell."""
    return rows.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("pairs"), positive_share("psnr_gain").alias("positive_pair_fraction"), *[F.avg(f).alias(f) for f in fields])


def factorial_cells(folders: DataFrame) -> DataFrame:
    """Folder statistics per (variant, seed, reference)."""
    g = "psnr_gain"
    return folders.groupBy("variant", "seed", "reference").agg(
        F.avg(g).alias("mean_gain"), F.stddev_samp(g).alias("std_gain"), F.sum((F.col(g) > 0).cast("bigint")).alias("positive_folders"),
        F.min(g).alias("worst_gain"), *[F.avg(f).alias(f"mean_{f}") for f in FIELDS if f != g])


def effect_contrasts() -> dict[str, list[float]]:
    """Weights of the four variants in each effect: the cells that differ in one factor, their means and their difference."""
    def minus(a: str, b: str) -> list[float]:
        return [float(v == a) - float(v == b) for v in VARIANTS]

    simple = {f"{a}_minus_{b}": minus(a, b) for a, b in (("P-H", "P-L"), ("H-H", "H-L"), ("H-L", "P-L"), ("H-H", "P-H"))}
    strength, structure = [simple["P-H_minus_P-L"], simple["H-H_minus_H-L"]], [simple["H-L_minus_P-L"], simple["H-H_minus_P-H"]]
    mean = lambda pair: [(x + y) / 2 for x, y in zip(*pair)]
    return {"strength_main": mean(strength), "structure_main": mean(structure), "interaction": [y - x for x, y in zip(*strength)], **simple}


def factorial_effects(folders: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """2x2 main effects, interaction and simple effects per (seed, reference, folder)."""
    key = ["seed", "reference", "folder"]
    cell = lambda v, f: F.max(F.when(F.col("variant") == v, F.col(f)))
    wide = folders.groupBy(*key).agg(*[F.array(*[cell(v, f) for v in VARIANTS]).alias(f) for f in fields])

    def contrast(weights: list[float], field: str) -> Column:
        terms = [F.get(field, F.lit(k)) * w for k, w in enumerate(weights) if w]
        return sum(terms[1:], terms[0])

    rows = F.array(*[F.struct(F.lit(name).alias("effect"), *[contrast(w, f).alias(f) for f in fields]) for name, w in effect_contrasts().items()])
    return wide.select(*key, F.explode(rows).alias("e")).select(*key, "e.*")


def _mean_spread(df: DataFrame, keys: list[str], unit: str, value: str, spread: Column, name: str) -> DataFrame:
    m = df.groupBy(*keys, unit).agg(F.avg(value).alias("m"))
    return m.groupBy(*keys).agg(spread.alias(name))


def effect_summary(effects: DataFrame, rounds: int, seed: int) -> DataFrame:
    """Effect size over folders with interval, seed and reference uncertainty."""
    fm = effects.groupBy("effect", "folder").agg(F.avg("psnr_gain").alias("m"))
    base = fm.groupBy("effect").agg(F.avg("m").alias("mean_effect"))
    ci = bootstrap_interval(fm, ["effect"], "folder", "m", rounds, seed)
    sd = _mean_spread(effects, ["effect"], "seed", "psnr_gain", F.stddev_samp("m"), "seed_std")
    rh = _mean_spread(effects, ["effect"], "reference", "psnr_gain", (F.max("m") - F.min("m")) / 2, "reference_half_difference")
    d = base.join(ci, "effect").join(sd, "effect").join(rh, "effect")
    u = F.greatest("seed_std", "reference_half_difference")
    return d.withColumn("effect_to_uncertainty", F.abs("mean_effect") / F.greatest(u, F.lit(1e-12))).withColumn(
        "stable_nonzero", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)) & (F.abs("mean_effect") > u))


def seed_t_interval(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Mean over seeds with the t interval for three seeds, and reference agreement of folders."""
    s = rows.groupBy("variant", "seed").agg(F.avg("psnr_gain").alias("g"), F.avg("ssim").alias("q"))
    n = F.count(F.lit(1))
    a = s.groupBy("variant").agg(n.alias("seeds"), F.avg("g").alias("mean_gain"), F.stddev_samp("g").alias("seed_std"),
                                 F.avg("q").alias("mean_ssim"), F.stddev_samp("q").alias("seed_std_ssim"))
    half = F.lit(T_CRITICAL_DF2) * F.col("seed_std") / F.sqrt(F.col("seeds"))
    a = a.withColumn("ci_low", F.col("mean_gain") - half).withColumn("ci_high", F.col("mean_gain") + half)
    ref = folders.groupBy("variant", "folder", "reference").agg(F.avg("psnr_gain").alias("g"))
    agree = reference_agreement(ref, "variant", "folder", "reference", "g", ("odd", "even")).select("variant", "sign_agreement", "correlation")
    worst = folders.groupBy("variant", "folder").agg(F.avg("psnr_gain").alias("g")).groupBy("variant").agg(
        F.min("g").alias("worst_folder_gain"), F.sum((F.col("g") > 0).cast("bigint")).alias("positive_folders"))
    return a.join(agree, "variant").join(worst, "variant")


def uncertainty_budget(cells: DataFrame, folders: DataFrame) -> DataFrame:
    """Largest seed std, reference half difference and matched-strength construction error."""
    sm = cells.groupBy("variant", "seed").agg(F.avg("mean_gain").alias("m")).groupBy("variant").agg(F.stddev_samp("m").alias("s"))
    rm = cells.groupBy("variant", "reference").agg(F.avg("mean_gain").alias("m")).groupBy("variant").agg(((F.max("m") - F.min("m")) / 2).alias("r"))
    std = folders.groupBy("variant").agg(F.avg("residual_std").alias("t"))
    one = sm.join(rm, "variant").join(std, "variant").agg(
        F.max("s").alias("max_seed_std"), F.max("r").alias("max_reference_half_difference"),
        *[F.max(F.when(F.col("variant") == v, F.col("t"))).alias(v) for v in VARIANTS])
    db = lambda a, b: F.abs(20 * F.log10(F.col(f"`{a}`") / F.col(f"`{b}`")))
    one = one.withColumn("construction_error_db", F.greatest(db("H-L", "P-L"), db("H-H", "P-H")))
    return one.select(
        "max_seed_std", "max_reference_half_difference", "construction_error_db",
        F.greatest("max_seed_std", "max_reference_half_difference", "construction_error_db").alias("max_uncertainty"))


def repeated_measure_summary(folders: DataFrame) -> DataFrame:
    """Per folder: mean, spread and ranges of the seed, reference and variant means."""
    g = folders.groupBy("folder").agg(
        F.count(F.lit(1)).alias("measures"), F.avg("psnr_gain").alias("mean_gain"), F.stddev_samp("psnr_gain").alias("sd_gain"),
        F.avg("gradient_ratio").alias("mean_gradient_ratio"), F.avg(F.abs("brightness_bias")).alias("mean_abs_bias"),
        positive_share("psnr_gain").alias("positive_fraction"))
    for unit in ("seed", "reference", "variant"):
        g = g.join(_mean_spread(folders, ["folder"], unit, "psnr_gain", F.max("m") - F.min("m"), f"{unit}_mean_range"), "folder")
    return g


def split_half_reliability(df: DataFrame, group: str, folder: str, a: str, b: str, limit: float, rounds: int = 1000, seed: int = 1, valid: Column | None = None) -> DataFrame:
    """Spearman of two halves per group, its interval over resampled folders, and how its sign survives leaving out each folder.

    ``valid`` is a condition on the rows of ``df`` that all rows of a group must meet to pass.
    An interval is NULL where no resample has a correlation.
    """
    full = rank_corr(df, [group], a, b, "rho")
    f = df.select(folder).distinct()
    pairs = paired(f, folder, unordered=False).select(F.col(f"a.{folder}").alias("heldout"), F.col(f"b.{folder}").alias(folder))
    loo = rank_corr(df.join(pairs, folder), [group, "heldout"], a, b, "r")
    s = loo.groupBy(group).agg(
        F.sum((F.col("r") > 1e-9).cast("bigint")).alias("loo_positive"), F.count("r").alias("loo_total"), F.min("r").alias("loo_min"), F.max("r").alias("loo_max"))
    boot = rank_corr(resampled_units(df, folder, rounds, seed), ["_b", group], a, b, "r")
    q = F.percentile("r", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    boot = boot.groupBy(group).agg(q.alias("_q"), F.avg((F.col("r") > 1e-9).cast("double")).alias("boot_positive")).select(
        group, F.element_at("_q", 2).alias("boot_median"), F.element_at("_q", 1).alias("ci_low"), F.element_at("_q", 3).alias("ci_high"), "boot_positive")
    ok = df.groupBy(group).agg(F.bool_and(F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)).alias("valid"))
    return full.drop("n").join(s, group).join(boot, group, "left").join(ok, group).withColumn(
        "passed", (F.col("rho") >= limit) & (F.col("loo_positive") == F.col("loo_total")) & F.col("valid"))


def collinearity_select(df: DataFrame, group: str, order: list[str], limit: float) -> DataFrame:
    """Keep metrics in the given order unless tied to an already kept one.

    The pair table comes from Spark; the decision is an expression over its (few) cells.
    """
    d = df
    for m in order:
        d = average_rank(d, [group], m, f"_r_{m}")
    pair = list(itertools.combinations(order, 2))
    per = d.groupBy(group).agg(*[corr_agg(f"_r_{a}", f"_r_{b}").alias(f"{a}|{b}") for a, b in pair])
    one = per.agg(*[F.max(F.abs(F.col(f"`{a}|{b}`"))).alias(f"{a}|{b}") for a, b in pair])
    kept: dict[str, Column] = {}
    rows = []
    for i, m in enumerate(order):
        clash = F.lit(None).cast("string")
        for k in reversed(order[:i]):
            clash = F.when(kept[k] & (F.col(f"`{k}|{m}`") >= limit), F.lit(k)).otherwise(clash)
        kept[m] = clash.isNull()
        rows.append(F.struct(F.lit(m).alias("metric"), F.when(clash.isNull(), "retained").otherwise(F.concat(F.lit("collinear_with_"), clash)).alias("status")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def association_audit(df: DataFrame, group: str, folder: str, x: str, y: str, control: str, outcomes: DataFrame | None = None, by: tuple[str, ...] = (), rounds: int = 1000, seed: int = 1) -> DataFrame:
    """Mean group-wise rank correlation of x and y: leave-one-out range, partial value for a control, interval over
    resampled folders, negative control, and with ``outcomes(group, folder, *by, y)`` its sign in every cell of ``by``.
    """
    d = df
    for c in (x, y, control):
        d = average_rank(d, [group], c, f"_r{c}")
    per = d.groupBy(group).agg(corr_agg(f"_r{x}", f"_r{y}").alias("rho"), partial_from_ranks(f"_r{x}", f"_r{y}", f"_r{control}").alias("partial"))
    base = per.agg(F.avg("rho").alias("rho"), F.avg("partial").alias("partial_rho"), F.sum((F.col("rho") <= 1e-9).cast("bigint")).alias("nonpositive_groups"), F.count("rho").alias("groups"))
    f = df.select(folder).distinct()
    pairs = paired(f, folder, unordered=False).select(F.col(f"a.{folder}").alias("heldout"), F.col(f"b.{folder}").alias(folder))
    loo = rank_corr(df.join(pairs, folder), [group, "heldout"], x, y, "r").groupBy("heldout").agg(F.avg("r").alias("r"))
    parts = [loo.agg(F.sum((F.col("r") <= 1e-9).cast("bigint")).alias("loo_nonpositive"), F.sum((F.abs("r") >= 0.3).cast("bigint")).alias("loo_medium"),
                     F.min("r").alias("loo_min"), F.max("r").alias("loo_max")),
             folder_bootstrap_rho(df, group, folder, x, y, rounds, seed).select("ci_low", "ci_high"),
             rank_corr(shuffled_control(df, group, folder, seed), [group], "control", y, "r").agg(F.avg("r").alias("control_rho"))]
    if outcomes is not None:
        cells = association_cells(df, outcomes, group, folder, x, y, by)
        parts.append(cells.agg(F.sum((F.col("rho") <= 1e-9).cast("bigint")).alias("cells_nonpositive"), F.count(F.lit(1)).alias("cells")))
    out = base.withColumn("_k", F.lit(1))
    for part in parts:  # one row each
        out = out.join(part.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k").withColumn("exceeds_control", F.abs("rho") > F.abs("control_rho"))


def association_cells(df: DataFrame, outcomes: DataFrame, group: str, folder: str, x: str, y: str, by: tuple[str, ...]) -> DataFrame:
    """Per cell of ``by`` (seed, reference): mean group-wise rank correlation of x with the cell's own outcomes."""
    d = outcomes.groupBy(group, folder, *by).agg(F.avg(y).alias(y)).join(df.select(group, folder, x), [group, folder])
    return rank_corr(d, [group, *by], x, y, "r").groupBy(*by).agg(
        F.avg("r").alias("rho"), F.coalesce(F.bool_and(F.col("r") <= 1e-9), F.lit(False)).alias("all_nonpositive"))


def shuffled_control(df: DataFrame, group: str, folder: str, seed: int) -> DataFrame:
    """Adds ``control``: a shuffled number of the folder inside each group, by md5(seed:group:folder)."""
    mixed = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(group).cast("string"), F.col(folder).cast("string")))
    return df.withColumn("control", F.row_number().over(W.partitionBy(group).orderBy(mixed)).cast("double"))


def association_decision(audit: DataFrame, p: str, folders: int) -> DataFrame:
    """GO, PARTIAL or NO_GO per audited metric from ``association_audit`` and a p value column."""
    # fixed values of the decision: p, medium leave-one-out values, partial correlation, cells
    every = (F.col("cells_nonpositive") == F.col("cells")) & (F.col("nonpositive_groups") == F.col("groups"))
    go = (F.col("rho") < 0) & (F.col(p) <= 0.05) & (F.col("loo_nonpositive") == folders) & (F.col("loo_medium") >= 8) & every & (F.col("partial_rho") <= -0.30) & F.col("exceeds_control")
    part = (F.col("rho") < 0) & (F.col("loo_nonpositive") >= 9) & (F.col("loo_medium") >= 6) & (F.col("cells_nonpositive") >= 4)
    return audit.withColumn("decision", F.when(go, "GO").when(part, "PARTIAL").otherwise("NO_GO"))


def partial_from_ranks(x: str, y: str, c: str) -> Column:
    """Partial correlation of x and y given c, as an aggregate."""
    xy, xc, yc = corr_agg(x, y), corr_agg(x, c), corr_agg(y, c)
    den = F.sqrt(F.greatest((1 - xc * xc) * (1 - yc * yc), F.lit(0.0)))
    return F.when(den > 1e-12, F.try_divide(xy - xc * yc, den))


def partial_rank_corr(df: DataFrame, keys: list[str], x: str, y: str, control: str) -> DataFrame:
    d = df
    for c in (x, y, control):
        d = average_rank(d, keys, c, f"_r{c}")
    return d.groupBy(*keys).agg(partial_from_ranks(f"_r{x}", f"_r{y}", f"_r{control}").alias("partial_rho"))


def bh_adjust(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Benjamini-Hochberg q values inside each (bounded) family of tests."""
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    ordered = w.orderBy(p)
    raw = F.col(p) * F.count(F.lit(1)).over(w) / F.row_number().over(ordered)
    d = df.withColumn("_raw", raw)
    return d.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(ordered.rowsBetween(0, W.unboundedFollowing)))).drop("_raw")


def rank_vectors(df: DataFrame, group: str, unit: str, x: str, y: str) -> DataFrame:
    """One row: centred rank vectors of x and y per group (units sorted), for permutation tests."""
    d = average_rank(average_rank(df, [group], x, "_rx"), [group], y, "_ry")
    g = d.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(unit, "_rx", "_ry"))).alias("_v"))
    return g.groupBy().agg(F.array_sort(F.collect_list(F.struct(group, F.col("_v._rx").alias("x"), F.col("_v._ry").alias("y")))).alias("g")).select(
        F.col("g.x").alias("xs"), F.col("g.y").alias("ys"))


def exact_permutation(df: DataFrame, group: str, unit: str, x: str, y: str) -> DataFrame:
    """Two-sided p over all n! relabelings of the units for the mean group-wise rank correlation.

    Above 20 units n! has no 64-bit number and the query fails; ``sampled_permutation`` takes any number.

    The n! permutations are cut into number ranges spread over tasks; each task
    decodes its range with numpy.
    """
    import numpy as np
    import pandas as pd

    step = 40_320
    base = rank_vectors(df, group, unit, x, y)
    n = F.size(F.element_at("xs", 1))
    total = F.coalesce(F.factorial(n), F.raise_error(F.lit("n! of the units has no 64-bit number")).cast("bigint"))
    jobs = base.withColumn("total", total).withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), total - 1, F.lit(step).cast("bigint"))))
    jobs = jobs.repartition(64, "start")

    def decode(start: int, count: int, n: int):
        """Rows of permutation numbers start.. in factorial base."""
        idx = np.arange(start, start + count)
        digits = np.empty((count, n), dtype=np.int64)
        for k in range(1, n + 1):
            digits[:, n - k] = idx % k
            idx = idx // k
        perm = digits.copy()
        for j in range(n - 2, -1, -1):
            perm[:, j + 1:] += perm[:, j + 1:] >= perm[:, j:j + 1]
        return perm

    def count_exceed(batches):
        for pdf in batches:
            out = []
            for xs, ys, total, start in zip(pdf["xs"], pdf["ys"], pdf["total"], pdf["start"]):
                X, Y = np.stack([np.asarray(v) for v in xs]), np.stack([np.asarray(v) for v in ys])
                X, Y = X - X.mean(1, keepdims=True), Y - Y.mean(1, keepdims=True)
                den = np.sqrt((X * X).sum(1) * (Y * Y).sum(1))
                observed = abs(((X * Y).sum(1) / den).mean())
                perm = decode(int(start), int(min(step, total - start)), X.shape[1])
                stat = np.zeros(len(perm))
                for xv, yv, dv in zip(X, Y, den):
                    stat += yv[perm] @ xv / dv
                out.append((float(observed), int((np.abs(stat / len(X)) >= observed - 1e-12).sum()), len(perm)))
            yield pd.DataFrame(out, columns=["observed", "exceed", "total"])

    per = jobs.mapInPandas(count_exceed, "observed double, exceed long, total long")
    return per.agg(F.max("observed").alias("observed_abs"), F.sum("exceed").alias("exceed"), F.sum("total").alias("permutations")).withColumn(
        "p_value", F.col("exceed") / F.col("permutations"))


def sampled_permutation(df: DataFrame, group: str, unit: str, x: str, y: str, draws: int = 1 << 20, seed: int = 1, miss: float = 0.001,
                        width: float | None = None, alpha: float | None = None, first: int = 1 << 14) -> DataFrame:
    """Two-sided p of ``exact_permutation`` from different permutations under a keyed bijection, for any number of units.

    Looks are taken after ``first``, 4 * first ... up to ``draws`` permutations, each look only over new numbers, and end
    once the interval is narrower than ``width`` or leaves ``alpha`` out. The interval [p_low, p_high] holds the exact p with
    probability 1 - ``miss`` over all looks together. With ``draws`` of n! or more all permutations are taken: p is exact.
    """
    spark = df.sparkSession
    base = rank_vectors(df, group, unit, x, y).persist()  # two short vectors a group
    sizes = base.select(F.size(F.element_at("xs", 1)).alias("n")).first() if not df.isEmpty() else None
    if sizes is None or sizes["n"] < 2:
        return spark.createDataFrame([], "observed_abs double, exceed long, permutations long, p_value double, p_low double, p_high double, exact boolean")
    n = sizes["n"]
    total = math.factorial(n)
    last = min(draws, total)
    looks = max(1, math.ceil(math.log(max(1, last / first), 4)) + 1)
    seen = exceed = 0
    low, high, observed = 0.0, 1.0, 0.0
    stop = min(first, last)
    while seen < last:
        found = _exceeding(base, seen, stop, n, seed).first()
        observed, exceed, seen = found["observed"], exceed + found["exceed"], stop
        low, high = (exceed / total,) * 2 if seen == total else share_interval(exceed, seen, miss / looks)
        if (width is not None and high - low <= width) or (alpha is not None and not low <= alpha <= high):
            break
        stop = min(4 * stop, last)
    base.unpersist()
    row = (observed, exceed, seen, exceed / seen, low, high, seen == total)
    return spark.createDataFrame([row], "observed_abs double, exceed long, permutations long, p_value double, p_low double, p_high double, exact boolean")


def _exceeding(base: DataFrame, start: int, stop: int, n: int, seed: int) -> DataFrame:
    """observed, exceed of permutation numbers [start, stop), cut into ranges over tasks."""
    import numpy as np
    import pandas as pd

    step = max(1024, 1 << 18 >> max(0, n.bit_length() - 3))
    jobs = base.withColumn("start", F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(stop - 1).cast("bigint"), F.lit(step).cast("bigint"))))

    def run(batches):
        for pdf in batches:
            out = []
            for xs, ys, at in zip(pdf["xs"], pdf["ys"], pdf["start"]):
                X, Y = np.stack([np.asarray(v) for v in xs]), np.stack([np.asarray(v) for v in ys])
                X, Y = X - X.mean(1, keepdims=True), Y - Y.mean(1, keepdims=True)
                den = np.sqrt((X * X).sum(1) * (Y * Y).sum(1))
                keep = den > 0  # a constant side has no correlation
                X, Y = X[keep] / den[keep, None], Y[keep]
                observed = abs((X * Y).sum() / max(1, len(X)))
                perm = keyed_permutations(int(at), min(step, stop - int(at)), n, seed)
                stat = sum((y[perm] @ x for x, y in zip(X, Y)), np.zeros(len(perm))) / max(1, len(X))
                out.append((observed, int((np.abs(stat) >= observed - 1e-12).sum())))
            yield pd.DataFrame(out, columns=["observed", "exceed"])

    per = jobs.repartition(64, "start").mapInPandas(run, "observed double, exceed long")
    return per.agg(F.max("observed").alias("observed"), F.sum("exceed").alias("exceed"))


def resampled_units(df: DataFrame, unit: str, rounds: int, seed: int) -> DataFrame:
    """Rows of ``df`` with ``_b`` and ``_slot``: in round b, slot i takes the unit md5(seed:b:i) mod n in unit order."""
    num = numbered(df.select(unit).distinct(), unit).withColumn("_i", (F.col("_i") - 1).cast("bigint"))
    draws = num.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).select(
        "_b", F.col("_i").alias("_slot"), hash_index([F.lit(seed), F.col("_b"), F.col("_i")], F.col("_n")).alias("_i"))
    return draws.join(num.select("_i", unit), "_i").join(df, unit).drop("_i")


def folder_bootstrap_rho(df: DataFrame, group: str, unit: str, x: str, y: str, rounds: int, seed: int) -> DataFrame:
    """Bootstrap of the mean rank correlation, resampling folders (not groups)."""
    r = rank_corr(resampled_units(df, unit, rounds, seed), ["_b", group], x, y, "r").groupBy("_b").agg(F.avg("r").alias("r"))
    q = F.percentile("r", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return r.agg(q.alias("_q"), F.count("r").alias("rounds")).select(
        *[F.element_at("_q", i + 1).alias(nm) for i, nm in enumerate(("ci_low", "median", "ci_high"))], "rounds")


# -- stability and gates over model tables -----------------------------------------

def seed_stability(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Deltas of variant a minus b per seed with direction counts over folders."""
    d = cells.groupBy("seed", "folder").agg(
        (F.avg(F.when(F.col("variant") == a, F.col("psnr_gain"))) - F.avg(F.when(F.col("variant") == b, F.col("psnr_gain")))).alias("d"))
    s = d.groupBy("seed").agg(
        F.avg("d").alias("mean_delta"), F.sum((F.col("d") > 0).cast("bigint")).alias("better_folders"),
        F.sum((F.col("d") < 0).cast("bigint")).alias("worse_folders"), F.max(F.abs("d")).alias("largest"), F.sum(F.abs("d")).alias("_t"))
    w = W.partitionBy(F.lit(1))
    return s.withColumn("dominance", safe_div("largest", "_t")).withColumn(
        "worse_in_two_seeds", F.sum((F.col("mean_delta") < 0).cast("bigint")).over(w) >= 2).drop("_t")


def normal_interval(df: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Descriptive statistics and 1.96-se interval for several key lists in one pass."""
    keys = sorted({k for s in sets for k in s})
    g = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"),
        F.stddev_samp(value).alias("std"), F.max(F.abs(value)).alias("max_abs"), positive_share(value).alias("positive_fraction"))
    se = F.col("std") / F.sqrt(dbl("n"))
    out = g.select(*[F.coalesce(F.col(k).cast("string"), F.lit("all")).alias(k) for k in keys], "n", "mean", "median", "std", "max_abs", "positive_fraction")
    return out.withColumn("ci_low", F.col("mean") - 1.96 * se).withColumn("ci_high", F.col("mean") + 1.96 * se).withColumn(
        "z", ratio("mean", se))


def level_gates(df: DataFrame, value: str, levels: dict[str, list[str]], limits: dict[str, float]) -> DataFrame:
    """Group means against a limit at several grouping levels."""
    out = None
    for name, keys in levels.items():
        m = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
        label = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
        m = m.select(F.lit(name).alias("level"), label.alias("grp"), "n", "mean", (F.abs("mean") <= limits[name]).alias("passed"))
        out = m if out is None else out.unionByName(m)
    return out


def content_seed_stability(df: DataFrame, content: str, seed: str, value: str, clip_ratio: str) -> DataFrame:
    """Per content: spread of a statistic over seeds and its worst clipping."""
    per = df.groupBy(content, seed).agg(F.avg(value).alias("v"), F.avg(clip_ratio).alias("c"))
    return per.groupBy(content).agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("seed_std"),
        F.coalesce(safe_div(F.stddev_samp("v"), F.avg("v")), F.lit(0.0)).alias("seed_cv"), F.max("c").alias("worst_clipping"))


def model_comparison(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Per folder: variant a against b on five checks, and how many it wins."""
    w = lambda v, f: F.avg(F.when(F.col("variant") == v, F.col(f)))
    g = cells.groupBy("folder").agg(
        (w(a, "psnr_gain") > w(b, "psnr_gain")).alias("gain_better"), (w(a, "ssim") > w(b, "ssim")).alias("ssim_better"),
        (w(a, "gradient_ratio") >= w(b, "gradient_ratio")).alias("gradient_kept"), (w(a, "residual_std") < w(b, "residual_std")).alias("residual_better"),
        (F.abs(w(a, "brightness_bias")) < F.abs(w(b, "brightness_bias"))).alias("bias_better"))
    names = ["gain_better", "ssim_better", "gradient_kept", "residual_better", "bias_better"]
    won = sum((F.col(n).cast("bigint") for n in names), F.lit(0).cast("bigint"))
    return g.withColumn("checks_won", won).withColumn("benefit", won >= 3)


def prior_parameters(fits: DataFrame, quality: str, minimum: float, columns: list[str]) -> DataFrame:
    """Median, min and max of per-folder parameters, only from folders with a good fit."""
    good = fits.where(finite(quality) >= minimum)
    return good.agg(F.count(F.lit(1)).alias("folders"), *[
        f(finite(c)).alias(f"{c}_{n}") for c in columns for f, n in ((F.median, "median"), (F.min, "min"), (F.max, "max"))])


def signal_anchors(cond: DataFrame, signal: str, slope: float, low: float, high: float) -> DataFrame:
    """Low, mid and high anchor of the calibration conditions with predicted noise and safety flag."""
    one = cond.agg(F.min(signal).alias("low"), F.percentile(signal, 0.5).alias("mid"), F.max(signal).alias("high"))
    rows = F.array(*[F.struct(F.lit(k).alias("anchor"), dbl(k).alias("target")) for k in ("low", "mid", "high")])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("predicted_sigma", F.lit(slope) * F.col("target")).withColumn(
        "safe", (F.col("predicted_sigma") > low) & (F.col("predicted_sigma") <= high))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("math",)]
