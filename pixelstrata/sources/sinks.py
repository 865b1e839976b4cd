"""Table, JSON and map sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_union(parts: list[DataFrame], common: list[str]) -> DataFrame:
    """Rows with differing columns in one table: common columns first, the rest in order of appearance."""
    cols = list(common)
    for p in parts:
        cols += [c for c in p.columns if c not in cols]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.select(*[c for c in cols if c in u.columns])


def write_csv_union(parts: list[DataFrame], common: list[str], path: str) -> None:
    csv_union(parts, common).write.mode("errorifexists").option("header", True).csv(path)


def json_safe(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def json_rows(df: DataFrame) -> DataFrame:
    """One strict JSON object per row: sorted keys, undefined numbers as null."""
    types = dict(df.dtypes)
    safe = [(json_safe(F.col(c)) if types[c] in ("double", "float") else F.col(c)).alias(c) for c in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("errorifexists").text(path)


def write_maps(maps: DataFrame, path: str) -> None:
    """Per-pixel maps (map_name, folder, y, x, value) as Parquet, one directory per map and folder."""
    maps.repartition("map_name", "folder", F.floor(F.col("y") / 512)).write.mode("errorifexists").partitionBy("map_name", "folder").parquet(path)


def long_maps(maps: DataFrame, names: list[str]) -> DataFrame:
    """Wide map columns to (map_name, folder, y, x, value)."""
    return maps.select("folder", "y", "x", F.explode(F.array(*[
        F.struct(F.lit(n).alias("map_name"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(
        "m.map_name", "folder", "y", "x", "m.value")
