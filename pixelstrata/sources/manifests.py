"""Pair, split, metadata and exposure-list readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelstrata.functions.ordering import ordinal_within

PAIR_COLUMNS = ("pair_key", "clean_path", "noisy_path")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header; a byte order mark in front of the first name is dropped."""
    r = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"')
    df = r.schema(schema).csv(path) if schema else r.csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def resolve_path(path: Column, root: str) -> Column:
    """Absolute paths stay; relative ones are put under ``root``."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def load_pair_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(pair_key, clean_path, noisy_path, metadata MAP); fails when a required column is missing."""
    df = read_table(spark, path)
    missing = sorted(set(PAIR_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"pair manifest lacks required columns: {missing}")
    extra = [c for c in df.columns if c not in PAIR_COLUMNS]
    if extra:
        meta = F.map_from_arrays(F.array(*[F.lit(c) for c in extra]), F.array(*[F.col(c).cast("string") for c in extra]))
        meta = F.map_filter(meta, lambda k, v: v.isNotNull() & (v != ""))
    else:
        meta = F.create_map().cast("map<string,string>")
    return df.select(
        "pair_key", resolve_path(F.col("clean_path"), root).alias("clean_path"),
        resolve_path(F.col("noisy_path"), root).alias("noisy_path"), meta.alias("metadata"))


def records_to_rows(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Metadata map back to columns."""
    return pairs.select(*PAIR_COLUMNS, *[F.try_element_at("metadata", F.lit(f)).alias(f) for f in fields])


def metadata_text(c: str = "metadata") -> Column:
    """Map rendered as sorted k=v list."""
    return F.concat_ws(";", F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))))


def load_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(split, ordinal, pair_key) from ``split:`` / ``  - key`` text files.

    Every file is one row until its lines are numbered; a large manifest is a folder
    of moderate files that each repeat their split header. Keys keep the order of
    (file name, line).
    """
    doc = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = doc.select("file", F.posexplode(F.split("value", "\n")).alias("n", "raw"))
    text = F.rtrim(F.split("raw", "#", 2).getItem(0))
    lines = lines.select("file", "n", text.alias("t")).where(F.col("t") != "")
    head = F.when(~F.col("t").startswith(" ") & F.col("t").endswith(":"), F.trim(F.expr("substring(t, 1, length(t) - 1)")))
    w = W.partitionBy("file").orderBy("n")
    d = lines.withColumn("split", F.last(head, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).where(
        F.ltrim("t").startswith("- ") & F.col("split").isNotNull())
    d = d.select("split", "file", "n", F.trim(F.expr("substring(ltrim(t), 3)")).alias("pair_key"))
    d = ordinal_within(d, "split", ["file", "n"], F.col("file"), "ordinal")
    return d.select("split", (F.col("ordinal") - 1).alias("ordinal"), "pair_key")


def write_split_manifest(splits: DataFrame, path: str, per_block: int = 10_000) -> None:
    """Write (split, ordinal, pair_key) as manifest text, in blocks that repeat the header.

    No split is ever gathered as a whole; file names follow the order of the keys.
    """
    line = F.concat(F.lit("  - "), F.col("pair_key").cast("string"))
    blocks = splits.groupBy("split", F.floor(F.col("ordinal") / per_block).alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", line.alias("l")))).alias("_l"))
    body = F.concat_ws("\n", F.concat("split", F.lit(":")), F.concat_ws("\n", F.col("_l.l")))
    parts = int(splits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks.repartitionByRange(parts, "split", "blk").sortWithinPartitions("split", "blk").select(body.alias("value")).write.text(path)


def resolve_split(pairs: DataFrame, splits: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """(pairs of the split with their ordinal, keys the manifest does not know)."""
    wanted = splits.where(F.col("split") == split)
    return wanted.join(pairs, "pair_key"), wanted.join(pairs, "pair_key", "left_anti")


EXPOSURE = r"^([0-9]+(?:\.[0-9]+)?)(ms|s)$"


def exposure_ms(label: Column) -> Column:
    """'500ms' / '2s' to milliseconds; NULL for anything else."""
    low = F.lower(label)
    num = F.nullif(F.regexp_extract(low, EXPOSURE, 1), F.lit("")).cast("double")
    return F.when(F.regexp_extract(low, EXPOSURE, 2) == "s", num * 1000.0).otherwise(num)


def exposure_label(path: Column) -> Column:
    """First path part that looks like an exposure."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda p: F.lower(p).rlike(EXPOSURE)), F.lit(1))


def exposure_sort_key(label: Column, dark: str) -> Column:
    """Dark folder first, then by duration, unparsable last."""
    return F.when(label == dark, F.lit(-1.0)).otherwise(F.coalesce(exposure_ms(label), F.lit(1e12)))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.[^.]*$", "")


def scene_frame(name: Column) -> tuple[Column, Column]:
    """scene_0012 -> (scene, 0012); names without a number keep an empty frame."""
    pat = r"^(.*)_([0-9]+)$"
    hit = name.rlike(pat)
    return (F.when(hit, F.regexp_extract(name, pat, 1)).otherwise(name), F.when(hit, F.regexp_extract(name, pat, 2)).otherwise(F.lit("")))


def exposure_pairs(lines: DataFrame, mode: str = "exposure") -> DataFrame:
    """Oriented pair rows from two-path lines; blank and comment lines are skipped.

    ``problem`` names lines that cannot be used instead of stopping the job.
    """
    d = lines.select(F.trim("line").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    d = d.withColumn("_p", F.split("line", r"\s+"))
    left, right = F.try_element_at("_p", F.lit(1)), F.try_element_at("_p", F.lit(2))
    d = d.select("line", F.size("_p").alias("_n"), left.alias("l"), right.alias("r"))
    d = d.withColumn("_lm", exposure_ms(exposure_label(F.col("l")))).withColumn("_rm", exposure_ms(exposure_label(F.col("r"))))
    first = {"exposure": F.col("_lm") >= F.col("_rm"), "first-clean": F.lit(True), "second-clean": F.lit(False)}[mode]
    d = d.withColumn("clean_path", F.when(first, F.col("l")).otherwise(F.col("r"))).withColumn("noisy_path", F.when(first, F.col("r")).otherwise(F.col("l")))
    c, n = exposure_label(F.col("clean_path")), exposure_label(F.col("noisy_path"))
    problem = F.when(F.col("_n") != 2, "expected 2 paths").when(c.isNull() | n.isNull(), "no exposure").when(
        stem(F.col("clean_path")) != stem(F.col("noisy_path")), "stem mismatch")
    sc, fr = scene_frame(stem(F.col("clean_path")))
    ms = lambda e: exposure_ms(e)
    return d.select(
        F.concat(stem(F.col("clean_path")), F.lit("__noisy_"), n, F.lit("__clean_"), c).alias("pair_key"), "clean_path", "noisy_path",
        sc.alias("scene_id"), fr.alias("frame_id"), ms(c).alias("clean_ms"), ms(n).alias("noisy_ms"), F.try_divide(ms(c), ms(n)).alias("exposure_ratio"),
        problem.alias("problem"))


def metadata_index(rows: DataFrame, name_cols: list[str], order: list[str]) -> DataFrame:
    """Metadata rows addressable by file name and by stem; the last row of a name wins."""
    keys = F.array_distinct(F.array_compact(F.flatten(F.array(*[
        F.array(F.nullif(stem(F.col(c)), F.lit("")), F.nullif(F.regexp_extract(F.col(c), "[^/]*$", 0), F.lit(""))) for c in name_cols]))))
    e = rows.withColumn("name", F.explode(keys))
    fields = [c for c in rows.columns if c not in order]
    # max over (order, row) is a partial aggregate: no sort of a hot name
    return e.groupBy("name").agg(F.max(F.struct(*order, *fields)).alias("_m")).select("name", *[F.col(f"_m.{c}").alias(c) for c in fields])


def read_metric_glob(spark: SparkSession, pattern: str, schema: str, expected: int | None = None) -> DataFrame:
    """Union of metric CSVs with their file name; ``complete`` tells whether all expected runs (folders) came.

    A run may be written as any number of part files.
    """
    d = spark.read.option("header", True).schema(schema).csv(pattern).withColumn("source_file", F.input_file_name())
    if expected is None:
        return d
    n = d.agg(F.count_distinct(F.regexp_replace("source_file", r"/[^/]*$", "")).alias("_n")).withColumn("_k", F.lit(1))
    return d.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k").withColumn("complete", F.col("_n") == expected).drop("_k", "_n")


def read_condition_tables(spark: SparkSession, paths: dict[str, str], key: str = "folder") -> dict[str, DataFrame]:
    """Named per-folder CSVs; the folder column may be written as 3 or 3.0."""
    return {n: read_table(spark, p).withColumn(key, F.col(key).cast("double").cast("bigint")) for n, p in paths.items()}
