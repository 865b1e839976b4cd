"""Named threshold checks that end in a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelstrata.functions.scalars import corr_agg, flag_list
from pixelstrata.operators.temporal import frame_stats, temporal_maps, with_half


def checks_table(one_row: DataFrame, checks: dict[str, Column], soft: set[str] = frozenset()) -> DataFrame:
    """(name, passed, hard, status): PASS when all hold, WARN when only soft ones fail, else FAIL."""
    hard_ok, all_ok = F.lit(True), F.lit(True)
    for k, v in checks.items():
        ok = F.coalesce(v, F.lit(False))
        all_ok = all_ok & ok
        if k not in soft:
            hard_ok = hard_ok & ok
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("passed"), F.lit(k not in soft).alias("hard"))
                     for k, v in checks.items()])
    status = F.when(all_ok, "PASS").when(hard_ok, "WARN").otherwise("FAIL")
    return one_row.select(status.alias("status"), F.explode(rows).alias("r")).select("r.*", "status")


def verdict(one_row: DataFrame, checks: dict[str, Column], key: list[str]) -> DataFrame:
    """GO when all checks hold, PARTIAL when the key ones do, else NO_GO; with the failed names."""
    every, some = F.lit(True), F.lit(True)
    for k, v in checks.items():
        ok = F.coalesce(v, F.lit(False))
        every = every & ok
        if k in key:
            some = some & ok
    failed = flag_list(*[(k, ~F.coalesce(v, F.lit(False))) for k, v in checks.items()])
    return one_row.select(
        F.when(every, "GO").when(some, "PARTIAL").otherwise("NO_GO").alias("status"), failed.alias("failed"),
        F.lit(len(checks)).cast("bigint").alias("checks"))


def repeated_frame_gate(px: DataFrame, lag: DataFrame, prof: DataFrame, targets: DataFrame, limits: dict[str, float], grid: int) -> DataFrame:
    """Per-folder checks that repeated frames can supervise each other."""
    ts = temporal_maps(px).groupBy("folder").agg(F.avg("std0").alias("temporal_std"))
    half = lambda c, s: F.avg(F.when(F.col("second") == s, F.col(c)))
    gd = with_half(frame_stats(px)).groupBy("folder").agg(F.abs(half("mean", True) - half("mean", False)).alias("_gd"))
    hp = with_half(px)
    ld = hp.groupBy("folder", F.floor(F.col("y") / grid), F.floor(F.col("x") / grid)).agg(
        F.abs(half("dn", True) - half("dn", False)).alias("d")).groupBy("folder").agg(F.max("d").alias("_ld"))
    fm = hp.groupBy("folder", "y", "x").agg(half("dn", False).alias("a"), half("dn", True).alias("b")).groupBy("folder").agg(corr_agg("a", "b").alias("_fm"))
    tr = targets.groupBy("folder").agg(
        (F.max(F.when(F.col("scheme") == "single_to_single", F.col("target_std")))
         / F.greatest(F.max(F.when(F.col("scheme") == "single_to_8mean", F.col("target_std"))), F.lit(1e-12))).alias("noise_reduction"))
    j = ts
    for part in (gd, ld, fm, tr, lag.select("folder", F.col("correlation_mean").alias("_lc")), prof):
        j = j.join(part, "folder")
    checks = {
        "global_drift": F.col("_gd") / F.col("temporal_std") <= limits["global_drift"],
        "local_drift": F.col("_ld") / F.col("temporal_std") <= limits["local_drift"],
        "residual_independence": F.abs("_lc") <= limits["residual"],
        "row_column_independence": F.greatest(F.abs("row_correlation"), F.abs("column_correlation")) <= limits["row_column"],
        "fixed_map_stable": F.coalesce("_fm", F.lit(0.0)) >= limits["fixed_map"],
    }
    ok = F.lit(True)
    for v in checks.values():
        ok = ok & v
    w = W.partitionBy(F.lit(1))  # one row per folder
    rank, n = F.row_number().over(w.orderBy("temporal_std", "folder")), F.count(F.lit(1)).over(w)
    return j.select(
        "folder", "temporal_std", "noise_reduction", *[v.alias(k) for k, v in checks.items()], ok.alias("passed"),
        (rank == 1).alias("is_low"), (rank == F.floor((n - 1) / 2) + 1).alias("is_mid"), (rank == n).alias("is_high"))


def state_repeatability(values: DataFrame) -> DataFrame:
    """Rank shift of each folder against all frames, and the worst and median order agreement.

    Input: (folder, subset, v) with one row per folder and named subset.
    """
    from pixelstrata.functions.ordering import add_bounded_quantiles, average_rank

    full = values.where(F.col("subset") == "all").select("folder", F.col("v").alias("f"))
    j = values.where(F.col("subset") != "all").join(full, "folder")
    j = average_rank(average_rank(j, ["subset"], "v", "ra"), ["subset"], "f", "rf")
    rho = add_bounded_quantiles(j.groupBy("subset").agg(corr_agg("ra", "rf").alias("rho")), [], "rho", {"median_rho": 0.5})
    rho = rho.agg(F.max("median_rho").alias("median_rho"), F.min("rho").alias("min_rho")).withColumn("_k", F.lit(1))
    s = j.groupBy("folder").agg(F.avg(F.abs(F.col("ra") - F.col("rf"))).alias("mean_rank_shift")).withColumn("_k", F.lit(1))
    return s.join(F.broadcast(rho), "_k").drop("_k")  # one row


def primary_checks(cells: DataFrame, primary: str, fixed: list[str], sharp: str | None = None, max_drop: float = 0.0) -> tuple[DataFrame, dict[str, Column]]:
    """Evidence row and named checks for a primary strategy, each taken inside every reference and required of all.

    Input: (reference, variant, folder, g, gradient). The mean gradient ratio of the primary may
    be at most ``max_drop`` below that of ``sharp`` (the last of ``fixed`` if not given) in every
    reference, so gain that comes from smoothing does not pass; a missing ratio does not either.
    """
    sharp = sharp or fixed[-1]
    s = cells.groupBy("reference", "variant").agg(F.avg("g").alias("m"), F.min("g").alias("w"), F.sum((F.col("g") > 0).cast("bigint")).alias("p"), F.avg("gradient").alias("d"))
    mine, other = F.col("variant") == primary, F.col("variant").isin(fixed)
    per = s.groupBy("reference").agg(F.max(F.when(mine, F.col("m"))).alias("m"), F.max(F.when(other, F.col("m"))).alias("best_fixed"),
                                     F.max(F.when(mine, F.col("w"))).alias("w"), F.max(F.when(mine, F.col("p"))).alias("p"),
                                     F.max(F.when(mine, F.col("d"))).alias("d"), F.max(F.when(F.col("variant") == sharp, F.col("d"))).alias("ds"))
    held = F.coalesce(F.col("d") >= F.col("ds") - F.lit(max_drop), F.lit(False))
    a = per.agg(F.min(F.col("m") - F.col("best_fixed")).alias("margin"), F.min("w").alias("w"), F.min("p").alias("p"), F.min(held.cast("int")).alias("held")).withColumn("_k", F.lit(1))
    ref = lambda r: F.max(F.when(F.col("reference") == r, F.col("g")))
    b = cells.where(mine).groupBy("folder").agg(ref("odd").alias("a"), ref("even").alias("b")).agg(
        F.avg((F.sign("a") == F.sign("b")).cast("double")).alias("agree")).withColumn("_k", F.lit(1))
    one = a.join(F.broadcast(b), "_k")
    return one, {
        "advantage": F.col("margin") > 0.05, "positive_folders": F.col("p") >= 8,
        "worst_folder": F.col("w") >= -0.5, "gradient": F.col("held") == 1, "sign_agreement": F.col("agree") >= 0.9}
