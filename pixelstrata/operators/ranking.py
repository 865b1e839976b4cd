"""Orderings, picks and set operations over listings and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelstrata.functions.ordering import average_rank, first_n, ordinal_within, range_ordinals


def natural_key(name: Column) -> list[Column]:
    """Sorts 2 before 10, a number of any length by its value, and names without a leading number last."""
    digits = F.regexp_extract(name, r"^(\d+)", 1)
    value = F.ltrim(digits, F.lit("0"))
    return [(digits == "").alias("_none"), F.length(value).alias("_size"), value.alias("_value"), name]


def natural_order(df: DataFrame, group: str, name: str) -> DataFrame:
    """Position of each name within its group in natural order; ``number`` is null where it passes 64 bits."""
    none, size, value, _ = natural_key(F.col(name))
    d = df.withColumn("number", F.regexp_extract(name, r"^(\d+)", 1).try_cast("bigint")).select("*", none, size, value)
    return range_ordinals(d, group, ["_none", "_size", "_value", name], "position").drop("_none", "_size", "_value")


def rank_within(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return average_rank(df, group, value, "rank")


def gain_rank(cells: DataFrame, group: str, strategy: str, value: str) -> DataFrame:
    """Rank of strategies inside each group, and whether the same one always leads."""
    w = W.partitionBy(group).orderBy(F.round(value, 9).desc(), strategy)
    d = cells.withColumn("gain_rank", F.row_number().over(w).cast("bigint"))
    everyone = W.partitionBy(F.lit(1))
    first = F.when(F.col("gain_rank") == 1, F.col(strategy))
    return d.withColumn("top_stable", F.min(first).over(everyone) == F.max(first).over(everyone))


def median_pick(df: DataFrame, group: str, order: list[str], bucket: Column) -> DataFrame:
    """The row at position n div 2 of each group's ordering, plus the first and the last."""
    d = ordinal_within(df, group, order, bucket, "_pos")
    n = d.groupBy(group).agg(F.max("_pos").alias("_n"))
    mid = F.floor(F.col("_n") / 2) + 1
    j = d.join(n, group).where((F.col("_pos") == 1) | (F.col("_pos") == F.col("_n")) | (F.col("_pos") == mid))
    picks = F.array_compact(F.array(
        F.when(F.col("_pos") == 1, F.lit("worst")), F.when(F.col("_pos") == mid, F.lit("median")), F.when(F.col("_pos") == F.col("_n"), F.lit("best"))))
    return j.withColumn("pick", F.explode(picks)).drop("_pos", "_n")


def ranked_samples(df: DataFrame, group: str, metric: str, tie: str, k: int) -> DataFrame:
    """Best k and worst k rows per group (top-k is pruned before the shuffle)."""
    best = first_n(df, group, [F.col(metric).desc(), F.col(tie)], k).withColumn("kind", F.lit("best"))
    worst = first_n(df, group, [F.col(metric).asc(), F.col(tie)], k).withColumn("kind", F.lit("worst"))
    return best.unionByName(worst)


def best_epoch(df: DataFrame, keys: list[str]) -> DataFrame:
    """Epoch with the best validation score (earliest on ties), last epoch and the drop to it."""
    b = F.min(F.struct((-F.col("validation")).alias("v"), "epoch"))
    l = F.max(F.struct("epoch", "validation"))
    return df.groupBy(*keys).agg(b.alias("_b"), l.alias("_l")).select(
        *keys, F.col("_b.epoch").alias("best_epoch"), (-F.col("_b.v")).alias("best_validation"), F.col("_l.epoch").alias("last_epoch"),
        F.col("_l.validation").alias("last_validation"), (-F.col("_b.v") - F.col("_l.validation")).alias("drop_from_best"))


def boundary_folders(df: DataFrame, subset: Column, value: str, folder: str) -> DataFrame:
    """Highest condition of the low subset and lowest of the high subset."""
    g = df.agg(
        F.max(F.when(subset == "low", F.struct(value, folder))).alias("lo"), F.min(F.when(subset == "high", F.struct(value, folder))).alias("hi"))
    rows = F.array(F.struct(F.lit("low").alias("subset"), F.col("lo").alias("r")), F.struct(F.lit("high").alias("subset"), F.col("hi").alias("r")))
    return g.select(F.explode(rows).alias("e")).select("e.subset", F.col(f"e.r.{folder}").alias(folder), F.col(f"e.r.{value}").alias(value))


def pivot_wide(df: DataFrame, keys: list[str], column: str, values: list[str], metric: str) -> DataFrame:
    """Long metrics to one column per listed value (values given, so no extra pass finds them)."""
    return df.groupBy(*keys).pivot(column, values).agg(F.avg(metric))


def subset_grouping(df: DataFrame, subset: str, strategy: str, value: str) -> DataFrame:
    """Each subset plus an all-conditions total in one pass."""
    g = df.groupingSets([[F.col(subset), F.col(strategy)], [F.col(strategy)]], F.col(subset), F.col(strategy)).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(value).alias("mean_gain"), F.avg((F.col(value) > 0).cast("double")).alias("positive_fraction"))
    return g.withColumn(subset, F.coalesce(subset, F.lit("all_conditions")))
