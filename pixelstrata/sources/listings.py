"""File listings and acquisition logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of all files below a folder; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return d.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def number_in(name: Column, where: str = "leading") -> Column:
    """Leading or trailing number of a file name (without suffix), NULL when there is none."""
    base = F.regexp_replace(F.regexp_extract(name, "[^/]*/?$", 0), r"/$", "")
    base = F.regexp_replace(base, r"\.[A-Za-z]+$", "")
    digits = F.regexp_extract(base, r"^(\d+)" if where == "leading" else r"(\d+)$", 1)
    # a number too long for an integer is no frame number; cutting it would let files share one
    return F.try_to_number(F.nullif(digits, F.lit("")), F.lit("9" * 38)).try_cast("bigint")


def frame_listing(files: DataFrame, folder: Column, number: Column, suffixes: list[str] | None = None) -> DataFrame:
    """(folder, frame_index, path, copies): one row per frame number, first path in name order.

    ``copies`` > 1 marks numbers claimed by several files.
    """
    d = files
    if suffixes:
        d = d.where(F.lower(F.regexp_extract("path", r"\.[^./]*$", 0)).isin([s.lower() for s in suffixes]))
    d = d.select(folder.alias("folder"), number.alias("frame_index"), "path").where(F.col("frame_index").isNotNull())
    return d.groupBy("folder", "frame_index").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


# fixed values: heads of the sections of a log line, and the published column names
LOG_SECTIONS = ["Exposure", "Sync.A", "Sync.B", "gain"]
LOG_FIELDS = ["exposure_delay_ms", "exposure_width_ms", "sync_a_delay_ns", "sync_a_width_us", "sync_b_delay_ns", "sync_b_width_us", "gain"]
NUMBER = r"[-+]?[0-9]*\.?[0-9]+"


def log_sections(line: Column) -> Column:
    """[file name, section bodies...] of a log line, cut at the section heads."""
    heads = "|".join(h.replace(".", r"\.") for h in LOG_SECTIONS)
    return F.split(line, rf"\s+(?=(?:{heads})(?![\w.]))")


def section_settings(section: Column) -> Column:
    """Map from ``<section>_<setting>_<unit>`` to number, from all ``setting:number unit`` tokens of a section."""
    head = F.lower(F.replace(F.regexp_extract(section, r"^\S+", 0), F.lit("."), F.lit("_")))
    tokens = F.regexp_extract_all(section, F.lit(rf"([A-Za-z]+:{NUMBER}[A-Za-z]+)"), F.lit(1))
    name = lambda t: F.concat(head, F.lit("_"), F.substring_index(t, ":", 1), F.lit("_"), F.regexp_extract(t, "[A-Za-z]+$", 0))
    return F.map_from_entries(F.transform(tokens, lambda t: F.struct(name(t), F.regexp_extract(t, rf":({NUMBER})", 1).cast("double"))))


def acquisition_log(lines: DataFrame, keep: list[str]) -> DataFrame:
    """Settings per log line; lines without a TIFF name or any of the sections and settings are skipped.

    The file name is everything before the first section, blanks included.
    """
    once = lambda c: F.explode(F.array(c))  # noqa: E731 -- filters on the parts would otherwise parse the line again for each part
    d = lines.select(*keep, once(log_sections(F.col("line"))).alias("_s"))
    d = d.where((F.size("_s") == len(LOG_SECTIONS) + 1) & F.lower(F.get("_s", F.lit(0))).rlike(r"\.tiff?$"))
    d = d.where(F.array(*[F.regexp_extract(F.get("_s", F.lit(k + 1)), r"^\S+", 0) for k in range(len(LOG_SECTIONS))]) == F.array(*map(F.lit, LOG_SECTIONS)))
    settings = F.map_concat(*[section_settings(F.get("_s", F.lit(k + 1))) for k in range(len(LOG_SECTIONS) - 1)])
    last = F.nullif(F.regexp_extract(F.get("_s", F.lit(len(LOG_SECTIONS))), NUMBER, 0), F.lit("")).cast("double")
    d = d.select(*keep, F.trim(F.get("_s", F.lit(0))).alias("filename"), once(settings).alias("_m"), last.alias("gain"))
    d = d.select(*keep, "filename", *[F.try_element_at("_m", F.lit(f)).alias(f) for f in LOG_FIELDS[:-1]], "gain")
    return d.dropna(subset=LOG_FIELDS)


def setting_text(fields: list[str] = LOG_FIELDS) -> Column:
    return F.concat_ws("|", *[F.col(f).cast("string") for f in fields])


def acquisition_constancy(log: DataFrame, setting: Column, order: str) -> DataFrame:
    """Lines, distinct settings and first setting per folder; whether folders share their first setting."""
    g = log.groupBy("folder").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct(setting).alias("settings"), F.min_by(setting, order).alias("first_setting"))
    # one row per folder from here
    same = g.agg((F.count_distinct("first_setting") == 1).alias("folders_identical")).withColumn("_k", F.lit(1))
    return g.withColumn("constant", F.col("settings") == 1).withColumn("_k", F.lit(1)).join(F.broadcast(same), "_k").drop("_k")
