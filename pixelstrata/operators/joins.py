"""Matching of files, pairs, conditions and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def paired_strategy_join(model: DataFrame, other: DataFrame, condition: DataFrame) -> DataFrame:
    """Two evaluation tables on pair_key, one row per strategy with its selected source and gain.

    ``condition``: (folder, high) decides the hybrid's source.
    """
    j = model.select("pair_key", "folder", F.col("psnr_gain").alias("gh")).join(
        other.select("pair_key", F.col("psnr_gain").alias("gp")), "pair_key").join(condition, "folder")
    row = lambda s, src, g: F.struct(F.lit(s).alias("strategy"), src.alias("source"), g.cast("double").alias("psnr_gain"))
    h = F.col("high")
    rows = F.array(
        row("always_noisy", F.lit("noisy"), F.lit(0.0)), row("always_p", F.lit("p"), F.col("gp")), row("always_h", F.lit("h"), F.col("gh")),
        row("hybrid", F.when(h, "h").otherwise("p"), F.when(h, F.col("gh")).otherwise(F.col("gp"))))
    return j.select("pair_key", "folder", F.explode(rows).alias("r")).select("r.strategy", "pair_key", "folder", "r.source", "r.psnr_gain")


def key_from_name(name: Column, regex: str) -> Column:
    """First capture group of the pattern, else the whole match, else the file stem."""
    from pixelstrata.sources.manifests import stem

    s = stem(name)
    if not regex:
        return s
    group = 1 if "(" in regex.replace("(?:", "") else 0
    return F.when(s.rlike(regex), F.regexp_extract(s, regex, group)).otherwise(s)


def pair_by_key(clean: DataFrame, noisy: DataFrame, regex: str) -> DataFrame:
    """Files of both sides with equal keys (first path of a key in name order)."""
    side = lambda d, n: d.groupBy(key_from_name(F.col("path"), regex).alias("pair_key")).agg(F.min("path").alias(n))
    return side(clean, "clean_path").join(side(noisy, "noisy_path"), "pair_key")


def pair_missing(clean: DataFrame, noisy: DataFrame, regex: str) -> DataFrame:
    """Keys present on one side only."""
    k = lambda d: d.select(key_from_name(F.col("path"), regex).alias("pair_key")).distinct()
    a, b = k(clean), k(noisy)
    return a.join(b, "pair_key", "left_anti").withColumn("missing_side", F.lit("noisy")).unionByName(
        b.join(a, "pair_key", "left_anti").withColumn("missing_side", F.lit("clean")))


def pair_duplicates(files: DataFrame, regex: str) -> DataFrame:
    """Keys claimed by more than one file, with the first path (the one that wins)."""
    return files.groupBy(key_from_name(F.col("path"), regex).alias("pair_key")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).where(F.col("copies") > 1)


def pair_metadata_merge(pairs: DataFrame, meta: DataFrame, fields: list[str], clean_ref: str, noisy_ref: str) -> DataFrame:
    """Both sides' metadata: equal fields once, different ones as clean_/noisy_ columns (missing = '')."""
    side = lambda n: meta.select(F.col("name").alias(f"_{n}"), *[F.col(f).cast("string").alias(f"_{n}_{f}") for f in fields])
    j = pairs.join(side("c"), pairs[clean_ref] == F.col("_c"), "left").join(side("n"), pairs[noisy_ref] == F.col("_n"), "left")
    out = [F.col(c) for c in pairs.columns]
    for f in fields:
        a, b = F.coalesce(F.col(f"_c_{f}"), F.lit("")), F.coalesce(F.col(f"_n_{f}"), F.lit(""))
        out += [F.when(a == b, a).alias(f), F.when(a != b, a).alias(f"clean_{f}"), F.when(a != b, b).alias(f"noisy_{f}")]
    return j.select(*out)


def pair_by_tail_index(a: DataFrame, b: DataFrame) -> DataFrame:
    """Match two folders on the trailing index (first path per index)."""
    first = lambda d, n: d.groupBy("idx").agg(F.min("path").alias(n))
    return first(a, "clean_path").join(first(b, "noisy_path"), "idx")


def exposure_pair_candidates(files: DataFrame, minimum: int) -> DataFrame:
    """For every shorter / longer exposure pair: one row per shared index, with counts and whether the pair is recommended.

    Input: (exposure, sort_key, idx). Rows meet on the index, so the work is the
    number of files times the (few) exposures.
    """
    d = files.groupBy("exposure", "sort_key", "idx").agg(F.lit(1).alias("_x")).drop("_x")
    n = d.groupBy("exposure", "sort_key").agg(F.count(F.lit(1)).alias("n"))
    b = d.select(F.col("exposure").alias("clean_exposure"), F.col("sort_key").alias("_kb"), "idx")
    common = d.select(F.col("exposure").alias("noisy_exposure"), F.col("sort_key").alias("_ka"), "idx").join(b, "idx").where(F.col("_ka") < F.col("_kb"))
    key = ["noisy_exposure", "clean_exposure"]
    count = common.groupBy(*key).agg(F.count(F.lit(1)).alias("common"))
    size = lambda c: n.select(F.col("exposure").alias(f"{c}_exposure"), F.col("n").alias(f"{c}_count"))
    pairs = count.join(size("noisy"), "noisy_exposure").join(size("clean"), "clean_exposure").withColumn("recommended", F.when(F.col("common") >= minimum, "yes").otherwise("no"))
    return common.select(*key, "idx").join(pairs, key)


def condition_assemble(parts: list[DataFrame], key: str, how: str = "full_outer") -> DataFrame:
    """Per-folder tables merged on the folder: all folders (full outer) or common ones (inner)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, how)
    return out


def grid_completeness(rows: DataFrame, factors: list[str]) -> DataFrame:
    """Expected factor grid against actual cells: missing and extra counts.

    The grid is never made: its size is the product of the levels, and every cell without a
    null lies in it. Cells with a null are extra.
    """
    actual = rows.select(*factors).distinct()
    whole = F.count_if(F.forall(F.array(*[F.col(f).isNotNull() for f in factors]), lambda x: x))
    sizes = rows.agg(*[F.count_distinct(f).alias(f"_n{k}") for k, f in enumerate(factors)])
    cells = actual.agg(F.count(F.lit(1)).alias("actual"), whole.alias("_whole"))
    expected = F.lit(1).cast("bigint")
    for k in range(len(factors)):
        expected = expected * F.col(f"_n{k}")
    both = sizes.select(expected.alias("expected"), F.lit(1).alias("_k")).join(cells.withColumn("_k", F.lit(1)), "_k")
    return both.select("expected", "actual", (F.col("expected") - F.col("_whole")).alias("missing"), (F.col("actual") - F.col("_whole")).alias("extra"))


def snapshot_drift(frozen: DataFrame, now: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Status of every key between two snapshots: unchanged, changed (which fields), missing, added."""
    a = frozen.select(key, F.lit(True).alias("_a"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = now.select(key, F.lit(True).alias("_b"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    j = a.join(b, key, "full_outer")
    diff = F.concat_ws(";", *[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in sorted(fields)])
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(diff == "", "unchanged").otherwise("changed")
    return j.select(key, status.alias("status"), F.when(status == "changed", diff).otherwise("").alias("changed_fields"))


def recompute_consistency(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Two outputs of one statistic within a relative tolerance."""
    j = a.select(*key, F.col(value).alias("first")).join(b.select(*key, F.col(value).alias("second")), key, "full_outer")
    rel = F.abs(F.col("first") - F.col("second")) / F.greatest(F.abs("first"), F.lit(1e-12))
    return j.withColumn("relative_error", rel).withColumn("consistent", F.coalesce(rel <= tolerance, F.lit(False)))


def cross_split_edges(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """Similarity edges whose ends lie in different splits."""
    s = lambda c: splits.select(F.col("pair_key").alias(c), F.col("split").alias(f"split_{c}"))
    return edges.join(s("a"), "a").join(s("b"), "b").where(F.col("split_a") != F.col("split_b"))


def round_robin_assign(items: DataFrame, position: str, conditions: DataFrame, slot: str) -> DataFrame:
    """Item i gets condition slot i mod n of the n conditions (both numbered from 0)."""
    n = conditions.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))  # one row
    return items.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k").withColumn(slot, F.col(position) % F.col("_n")).drop("_k", "_n").join(conditions, slot)


def nearest_quantile_pick(items: DataFrame, key: str, value: str, tie: str, quantiles: list[float]) -> DataFrame:
    """For every target quantile the nearest content not used before (ties by ``tie``).

    Per target only the ``rank`` nearest candidates can win (earlier targets use up
    at most rank - 1 of them), so the greedy choice runs over a handful of rows.
    """
    from pixelstrata.functions.ordering import exact_quantiles

    names = {f"q{i}": q for i, q in enumerate(quantiles)}
    t = exact_quantiles(items, [], value, names).withColumn("_k", F.lit(1))
    rows = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(float(q)).alias("quantile"), F.col(f"q{i}").alias("target")) for i, q in enumerate(quantiles)])
    targets = t.select("_k", F.explode(rows).alias("t")).select("_k", "t.*")
    d = items.select(key, F.col(value).cast("double").alias("v"), tie).withColumn("_k", F.lit(1)).join(F.broadcast(targets), "_k").drop("_k")
    d = d.withColumn("distance", F.abs(F.col("v") - F.col("target")))
    w = W.partitionBy("rank").orderBy("distance", tie)
    near = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= len(quantiles)).where(F.col("_r") <= F.col("rank"))
    lists = near.groupBy("rank", "quantile", "target").agg(F.array_sort(F.collect_list(F.struct("_r", key, "v", "distance"))).alias("c"))
    packed = lists.agg(F.array_sort(F.collect_list(F.struct("rank", "quantile", "target", "c"))).alias("all"))
    empty = F.array().cast("array<bigint>")

    def step(acc, row):
        free = F.filter(row["c"], lambda x: ~F.array_contains(acc, x[key]))
        return F.concat(acc, F.array(free[0][key]))

    chosen = packed.withColumn("ids", F.aggregate("all", empty, step))
    e = chosen.select(F.explode(F.arrays_zip("all", "ids")).alias("z")).select("z.all.rank", "z.all.quantile", "z.all.target", "z.ids", "z.all.c")
    hit = F.filter("c", lambda x: x[key] == F.col("ids"))[0]
    return e.select(F.col("rank").cast("bigint").alias("selection_rank"), "quantile", "target", F.col("ids").alias(key), hit["distance"].alias("distance"))


def role_tag_join(rows: DataFrame, roles: DataFrame, key: str) -> DataFrame:
    """Attach the frozen role; rows without one and roles without rows stay visible as drift."""
    j = rows.join(roles, key, "full_outer")
    seen = [c for c in rows.columns if c != key][0]
    return j.withColumn("drift", F.when(F.col("role").isNull(), "role missing").when(F.col(seen).isNull(), "folder missing").otherwise(""))
