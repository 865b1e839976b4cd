"""Logical views on the given tables: the same definition for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelstrata.functions.ordering import ordinal_within
from pixelstrata.operators.frames import explode_tiles
from pixelstrata.operators.inference import factorial_folders
from pixelstrata.operators.pairs import odd_even_pairs
from pixelstrata.operators.similarity import character_profile
from pixelstrata.operators.text_similarity import Texts, text_sets

SIDE = 8  # an embedding of 64 numbers is one 8 x 8 frame
RANGE = 65535.0
TIME_BUCKET = "hour"  # sub-range of a long trace that is numbered on its own


class Tables:
    """The given tables of one scale directory and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- frames ---------------------------------------------------------
    def tiles(self) -> DataFrame:
        """(folder, frame, top, left, h, w, dn): one row per frame, 16-bit values."""
        e = self.read("embeddings").select(
            F.col("label").cast("bigint").alias("folder"), "vec_id", "embedding"
        )
        e = ordinal_within(e, "folder", ["vec_id"], F.floor(F.col("vec_id") / 65536))
        dn = F.transform(
            "embedding",
            lambda v: F.round((F.least(F.greatest(v.cast("double"), F.lit(-1.0)), F.lit(1.0)) + 1) * 32767)
            .cast("bigint"),
        )
        return e.select(
            "folder", "frame", F.lit(0).alias("top"), F.lit(0).alias("left"),
            F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), dn.alias("dn"),
        )

    def pixels(self) -> DataFrame:
        """(folder, frame, y, x, dn), hash-partitioned by (folder, frame)."""
        return explode_tiles(self.tiles(), colocate=True)

    def pixels_anywhere(self) -> DataFrame:
        """Same rows without the (folder, frame) placement: for per-pixel statistics."""
        return explode_tiles(self.tiles())

    def pairs(self) -> DataFrame:
        """(pair_key, folder, frame, y, x, clean, noisy): even frames against the mean of odd ones."""
        return odd_even_pairs(self.pixels_anywhere())

    def predictions(self) -> DataFrame:
        """(strategy, pair_key, folder, frame, y, x, clean, noisy, value): three stand-in outputs."""
        return self.predicted(self.pairs(), lambda f: f(F.col("noisy"), F.col("clean")))

    @staticmethod
    def predicted(pairs: DataFrame, each) -> DataFrame:
        """Adds strategy and value of the stand-in outputs; ``each`` applies a function to noisy and clean values, pixels or tiles."""
        kinds = F.array(
            F.struct(F.lit("noisy").alias("strategy"), F.col("noisy").alias("value")),
            F.struct(F.lit("p").alias("strategy"), each(lambda n, c: F.floor((3 * n + c) / 4)).alias("value")),
            F.struct(F.lit("q").alias("strategy"), each(lambda n, c: F.floor((n + c) / 2)).alias("value")),
        )
        return pairs.withColumn("_s", F.explode(kinds)).select("*", "_s.strategy", "_s.value").drop("_s")

    # -- traces, logs, listings -----------------------------------------
    def trace(self) -> DataFrame:
        """(folder, frame, ts, event_id, value): one value per frame, in time order."""
        e = self.read("events").select(
            F.col("event_type").alias("folder"), "ts", "event_id",
            F.round(F.col("value") * 100).cast("bigint").alias("value"),
        )
        return ordinal_within(e, "folder", ["ts", "event_id"], F.date_trunc(TIME_BUCKET, "ts"))

    def log_lines(self) -> DataFrame:
        """(folder, event_id, line): acquisition log text; every 50th line is damaged."""
        good = F.concat(
            F.col("event_id").cast("string"), F.lit("-Camera1.tif Exposure delay:0ms, width:"),
            F.round(F.col("value") * 100).cast("bigint").cast("string"),
            F.lit("ms Sync.A delay:0ns, width:4us Sync.B delay:0ns, width:4us gain "),
            F.col("user_id").cast("string"),
        )
        line = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("damaged "), F.col("event_id").cast("string"))).otherwise(good)
        return self.read("events").select(F.col("event_type").alias("folder"), "event_id", line.alias("line"))

    def paths(self) -> DataFrame:
        """(page_id, path): URLs as file paths, scheme and query removed."""
        return self.read("pages").select(
            "page_id",
            F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"),
        )

    def indices(self) -> DataFrame:
        """(folder, idx): distinct frame numbers per folder, with gaps."""
        return self.read("orders").select(
            (F.col("o_custkey") % 10).cast("bigint").alias("folder"),
            (F.col("o_orderkey") % 2000).cast("bigint").alias("idx"),
        ).distinct()

    # -- metric and condition tables ------------------------------------
    def metrics(self) -> DataFrame:
        """Strategy metric rows (variant, seed, reference, folder, pair_key, ...)."""
        c = F.col
        return self.read("lineitem").select(
            F.when(c("l_linestatus") == "F", "P").otherwise("H").alias("structure"),
            F.when(c("l_returnflag") == "A", "L").otherwise("H").alias("strength"),
            F.concat(
                F.when(c("l_linestatus") == "F", "P").otherwise("H"), F.lit("-"),
                F.when(c("l_returnflag") == "A", "L").otherwise("H"),
            ).alias("variant"),
            (F.lit(20260716) + c("l_linenumber") % 3).cast("bigint").alias("seed"),
            F.when(c("l_orderkey") % 2 == 1, "odd").otherwise("even").alias("reference"),
            (c("l_suppkey") % 10).cast("bigint").alias("folder"),
            c("l_orderkey").alias("pair_key"),
            F.round((c("l_discount") - c("l_tax")) * 100).cast("bigint").alias("psnr_gain"),
            (100 - F.round(c("l_tax") * 100)).cast("bigint").alias("ssim"),
            (80 + 2 * F.round(c("l_discount") * 100)).cast("bigint").alias("gradient_ratio"),
            F.round("l_extendedprice").cast("bigint").alias("residual_std"),
            (F.round("l_quantity") - 25).cast("bigint").alias("brightness_bias"),
        )

    def conditions(self) -> DataFrame:
        """(folder, mean_signal, temporal_std_mean, fano, stable_ratio) by nation: 25 conditions."""
        cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
        c = self.read("customer").groupBy(F.col("c_nationkey").cast("bigint").alias("folder")).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(cents("c_acctbal")).alias("s"),
            F.max(cents("c_acctbal")).alias("hi"),
            F.min(cents("c_acctbal")).alias("lo"),
        )
        s = self.read("supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("folder")).agg(
            F.count(F.lit(1)).alias("sn"), F.sum(cents("s_acctbal")).alias("ss")
        )
        return c.join(s, "folder", "left").select(
            "folder",
            F.round(F.col("s").cast("double") / F.col("n"), 2).alias("mean_signal"),
            ((F.col("hi") - F.col("lo")) / F.lit(100)).cast("double").alias("temporal_std_mean"),
            F.round(F.coalesce(F.try_divide(F.col("ss").cast("double"), F.col("sn")), F.lit(0.0)), 2).alias("fano"),
            F.col("n").cast("double").alias("stable_ratio"),
        )

    def evals(self) -> DataFrame:
        """(model, pair_key, folder, psnr_gain, ssim, gradient_ratio, residual_std): two evaluation tables."""
        avg = lambda c: F.avg(c).alias(c)
        return self.metrics().groupBy(F.col("structure").alias("model"), "pair_key").agg(
            avg("psnr_gain"), avg("ssim"), avg("gradient_ratio"), avg("residual_std")
        ).withColumn("folder", F.col("pair_key") % 25)

    def cells(self) -> DataFrame:
        """Means of the strategy metrics per (variant, seed, reference, folder)."""
        return factorial_folders(self.metrics())

    def manifest(self) -> DataFrame:
        """(pair_key, scene, grp, sha, path): one row per content."""
        return self.read("documents").select(
            F.col("doc_id").alias("pair_key"), F.col("lang").alias("scene"), F.col("source").alias("grp"),
            F.sha2("text", 256).alias("sha"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
            F.col("n_chars").alias("size"),
        )

    def contents(self, table: str = "documents", key: str = "doc_id", n: int = 64) -> DataFrame:
        """(id, vec): unit vectors of n character counts (all code points modulo n), a stand-in content image."""
        return character_profile(self.read(table), key, "text", n)

    def texts(self) -> Texts:
        """Whole documents, whose shingle sets are formed in each pass."""
        return Texts(self.read("documents").select(F.col("doc_id").alias("id"), "text"))

    def text_sets(self, table: str = "documents", key: str = "doc_id") -> DataFrame:
        """(id, sha, shingles, bands): what identifies a whole text and what finds its near copies."""
        return text_sets(self.read(table), key, "text")

    def epochs(self) -> DataFrame:
        """(run_seed, model, epoch, validation): one validation score per epoch."""
        return self.read("events").groupBy(
            (F.col("user_id") % 3).cast("bigint").alias("run_seed"),
            F.col("event_type").alias("model"),
            F.dayofmonth("ts").cast("bigint").alias("epoch"),
        ).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("validation"))


# The same views in SQL, in dependency order.
SQL_VIEWS: dict[str, str] = {
    "fx_frames": """
        SELECT folder, frame, CAST((pos - 1) // 8 AS BIGINT) AS y, CAST((pos - 1) % 8 AS BIGINT) AS x,
               CAST(round((least(greatest(CAST(v AS DOUBLE), -1), 1) + 1) * 32767) AS BIGINT) AS dn
        FROM (SELECT folder, frame, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos
              FROM (SELECT CAST(label AS BIGINT) AS folder, embedding,
                           row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame FROM embeddings))""",
    "fx_maps": """
        SELECT folder, y, x, count(*) AS n, avg(dn) AS mean, var_pop(dn) AS var0, var_samp(dn) AS var1,
               stddev_pop(dn) AS std0, stddev_samp(dn) AS std1, median(CAST(dn AS DOUBLE)) AS med
        FROM fx_frames GROUP BY ALL""",
    "fx_fstat": """
        SELECT folder, frame, count(*) AS n, avg(dn) AS mean, stddev_pop(dn) AS std, var_pop(dn) AS var
        FROM fx_frames GROUP BY ALL""",
    "fx_counts": "SELECT folder, max(frame) AS frames FROM fx_frames GROUP BY folder",
    "fx_resid": """
        SELECT f.folder, f.frame, f.y, f.x, f.dn - m.mean AS r
        FROM fx_frames f JOIN fx_maps m USING (folder, y, x)""",
    "fx_resid0": """
        SELECT f.folder, f.frame, f.y, f.x, f.dn - m.mean - a.d AS r
        FROM fx_frames f JOIN fx_maps m USING (folder, y, x)
        JOIN (SELECT folder, frame, avg(r) AS d FROM fx_resid GROUP BY ALL) a USING (folder, frame)""",
    "fx_clean": """
        SELECT folder, y, x, CAST(sum(dn) // count(*) AS BIGINT) AS clean
        FROM fx_frames WHERE frame % 2 = 1 GROUP BY ALL""",
    "fx_pairs": """
        SELECT 'folder_' || folder || '_frame_' || frame AS pair_key, folder, frame, y, x, clean, dn AS noisy
        FROM fx_frames JOIN fx_clean USING (folder, y, x) WHERE frame % 2 = 0""",
    "fx_pred": """
        SELECT s.strategy, pair_key, folder, frame, y, x, clean, noisy,
               CASE s.strategy WHEN 'noisy' THEN noisy WHEN 'p' THEN (3 * noisy + clean) // 4
                    ELSE (noisy + clean) // 2 END AS value
        FROM fx_pairs, (VALUES ('noisy'), ('p'), ('q')) s(strategy)""",
    "fx_trace": """
        SELECT event_type AS folder, ts, event_id, CAST(round(value * 100) AS BIGINT) AS value,
               row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS frame FROM events""",
    "fx_log": """
        SELECT event_type AS folder, event_id,
          CASE WHEN event_id % 50 = 0 THEN 'damaged ' || event_id ELSE
            event_id || '-Camera1.tif Exposure delay:0ms, width:' || CAST(round(value * 100) AS BIGINT)
            || 'ms Sync.A delay:0ns, width:4us Sync.B delay:0ns, width:4us gain ' || user_id END AS line
        FROM events""",
    "fx_paths": """
        SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages""",
    "fx_index": """
        SELECT DISTINCT CAST(o_custkey % 10 AS BIGINT) AS folder, CAST(o_orderkey % 2000 AS BIGINT) AS idx FROM orders""",
    "fx_metrics": """
        SELECT CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'H' END AS structure,
          CASE WHEN l_returnflag = 'A' THEN 'L' ELSE 'H' END AS strength,
          (CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'H' END) || '-' ||
          (CASE WHEN l_returnflag = 'A' THEN 'L' ELSE 'H' END) AS variant,
          CAST(20260716 + l_linenumber % 3 AS BIGINT) AS seed,
          CASE WHEN l_orderkey % 2 = 1 THEN 'odd' ELSE 'even' END AS reference,
          CAST(l_suppkey % 10 AS BIGINT) AS folder, l_orderkey AS pair_key,
          CAST(round((l_discount - l_tax) * 100) AS BIGINT) AS psnr_gain,
          CAST(100 - round(l_tax * 100) AS BIGINT) AS ssim,
          CAST(80 + 2 * round(l_discount * 100) AS BIGINT) AS gradient_ratio,
          CAST(round(l_extendedprice) AS BIGINT) AS residual_std,
          CAST(round(l_quantity) - 25 AS BIGINT) AS brightness_bias
        FROM lineitem""",
    "fx_eval": """
        SELECT structure AS model, pair_key, pair_key % 25 AS folder, avg(psnr_gain) AS psnr_gain, avg(ssim) AS ssim,
          avg(gradient_ratio) AS gradient_ratio, avg(residual_std) AS residual_std FROM fx_metrics GROUP BY structure, pair_key""",
    "fx_cells": """
        SELECT variant, seed, reference, folder, count(*) AS pairs, avg((psnr_gain > 0)::INT) AS positive_pair_fraction, avg(psnr_gain) AS psnr_gain,
          avg(ssim) AS ssim, avg(gradient_ratio) AS gradient_ratio, avg(residual_std) AS residual_std, avg(brightness_bias) AS brightness_bias
        FROM fx_metrics GROUP BY ALL""",
    "fx_cond": """
        SELECT c.folder, round(CAST(s AS DOUBLE) / n, 2) AS mean_signal,
          CAST((hi - lo) / 100 AS DOUBLE) AS temporal_std_mean,
          round(coalesce(CAST(ss AS DOUBLE) / sn, 0), 2) AS fano, CAST(n AS DOUBLE) AS stable_ratio
        FROM (SELECT CAST(c_nationkey AS BIGINT) AS folder, count(*) AS n,
                CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS s,
                max(CAST(round(c_acctbal * 100) AS BIGINT)) AS hi,
                min(CAST(round(c_acctbal * 100) AS BIGINT)) AS lo FROM customer GROUP BY 1) c
        LEFT JOIN (SELECT CAST(s_nationkey AS BIGINT) AS folder, count(*) AS sn,
                CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS ss FROM supplier GROUP BY 1) p
        ON c.folder = p.folder""",
    "fx_manifest": """
        SELECT doc_id AS pair_key, lang AS scene, source AS grp, sha256(text) AS sha,
               source || '/' || doc_id AS path, n_chars AS size FROM documents""",
    "fx_counts64": """
        SELECT doc_id AS id, list_transform(range(64), lambda k: coalesce(m[k], 0)) AS c FROM (SELECT doc_id, map_from_entries(list((k, n))) AS m FROM (
            SELECT doc_id, (unicode(c) % 64)::BIGINT AS k, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY ALL) GROUP BY doc_id)""",
    "fx_centred": "SELECT id, list_transform(c, lambda v: CAST(v AS DOUBLE) - CAST(list_sum(c) AS DOUBLE) / 64) AS c FROM fx_counts64",
    "fx_unit": """
        SELECT id, CASE WHEN n > 1e-12 THEN list_transform(c, lambda v: v / n) ELSE list_transform(c, lambda v: 0.0::DOUBLE) END AS u
        FROM (SELECT id, c, sqrt(list_sum(list_transform(c, lambda v: v * v))) AS n FROM fx_centred)""",
    "fx_shingles": """
        SELECT id, sha, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM (SELECT doc_id AS id, sha256(text) AS sha, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda v: v <> '') AS w FROM (SELECT doc_id, text || substr(doc_id::VARCHAR, 1, 0) AS text FROM documents))""",
    "fx_reps": "SELECT sha, min(id) AS id, count(*) AS copies FROM fx_shingles GROUP BY sha",
    "fx_grams": "SELECT r.id, len(s) AS n, unnest(list_transform(s, lambda v: hash(v))) AS g FROM fx_reps r JOIN fx_shingles q ON q.id = r.id",
    "fx_met": "SELECT list_sort(list(id)) AS ids FROM fx_grams GROUP BY g HAVING count(*) > 1",
    "fx_near": """
        SELECT a, b, n::DOUBLE / (na + nb - n) AS corr FROM (
            SELECT p.a, p.b, count(*) AS n, any_value(len(x.s)) AS na, any_value(len(y.s)) AS nb
            FROM (SELECT a, unnest(list_filter(ids, lambda v: v > a)) AS b FROM (SELECT ids, unnest(ids) AS a FROM fx_met)) p
            JOIN fx_shingles x ON x.id = p.a JOIN fx_shingles y ON y.id = p.b GROUP BY p.a, p.b)
        WHERE n::DOUBLE / (na + nb - n) >= 0.8""",
    "fx_star": "SELECT r.id AS a, d.id AS b, 1.0::DOUBLE AS corr FROM fx_reps r JOIN fx_shingles d ON r.sha = d.sha AND d.id <> r.id",
    "fx_edges": "SELECT a, b, corr, 'near_content' AS kind FROM fx_near UNION ALL SELECT a, b, corr, 'exact_copy' FROM fx_star",
    "fx_epoch": """
        SELECT CAST(user_id % 3 AS BIGINT) AS run_seed, event_type AS model,
               CAST(day(ts) AS BIGINT) AS epoch, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS validation
        FROM events GROUP BY ALL""",
}
