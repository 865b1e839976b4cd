"""File matching, condition merging and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelstrata.functions.ordering import ordinal_within, range_ordinals
from pixelstrata.functions.resampling import paired
from pixelstrata.functions.scalars import big, rnd
from pixelstrata.operators import curation as C
from pixelstrata.operators import joins as J
from pixelstrata.operators import similarity as M
from pixelstrata.operators.temporal import frame_stats, lag_pairs, temporal_maps
from pixelstrata.plans.queries_temporal import sel
from pixelstrata.plans.registry import query
from pixelstrata.plans.views import Tables
from pixelstrata.sources import listings as L
from pixelstrata.sources import manifests as N
from pixelstrata.sources import raw_stacks, sinks
from pixelstrata.sources.storage import fresh_path

S = "string"


# -- two file listings: clean from documents, noisy from labels ----------------------
FILES = """
    cf AS (SELECT 'clean/doc_' || doc_id || '_c.tif' AS path, doc_id::VARCHAR AS pair_key FROM documents),
    nf AS (SELECT 'noisy/doc_' || (doc_id * 2) || '_n.tif' AS path, (doc_id * 2)::VARCHAR AS pair_key FROM labels)"""
KEY = r"doc_(\d+)"


def files(t: Tables):
    c = t.read("documents").select(F.concat(F.lit("clean/doc_"), F.col("doc_id").cast(S), F.lit("_c.tif")).alias("path"))
    n = t.read("labels").select(F.concat(F.lit("noisy/doc_"), (F.col("doc_id") * 2).cast(S), F.lit("_n.tif")).alias("path"))
    return c, n


@query("pair_by_key", f"WITH {FILES} SELECT pair_key, cf.path AS clean_path, nf.path AS noisy_path FROM cf JOIN nf USING (pair_key)")
def _(t: Tables):
    return J.pair_by_key(*files(t), KEY)


@query("pair_missing", f"WITH {FILES} SELECT pair_key, 'noisy' AS missing_side FROM cf WHERE pair_key NOT IN (SELECT pair_key FROM nf) UNION ALL SELECT pair_key, 'clean' FROM nf WHERE pair_key NOT IN (SELECT pair_key FROM cf)")
def _(t: Tables):
    return J.pair_missing(*files(t), KEY)


@query("pair_duplicates", """
    WITH k AS (SELECT path, coalesce(nullif(regexp_extract(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''), '(\\d+)', 1), ''), regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')) AS pair_key FROM fx_paths)
    SELECT pair_key, count(*) AS copies, min(path) AS first_path FROM k GROUP BY pair_key HAVING count(*) > 1""")
def _(t: Tables):
    return J.pair_duplicates(t.paths(), r"(\d+)")


@query("pair_metadata_merge", """
    WITH p AS (SELECT doc_id AS pair_key, doc_id::VARCHAR AS clean_ref, (doc_id + 1)::VARCHAR AS noisy_ref FROM documents),
      m AS (SELECT doc_id::VARCHAR AS name, coalesce(quality::VARCHAR, '') AS q, coalesce(toxic::VARCHAR, '') AS x FROM labels),
      j AS (SELECT p.*, coalesce(a.q, '') AS aq, coalesce(b.q, '') AS bq, coalesce(a.x, '') AS ax, coalesce(b.x, '') AS bx FROM p LEFT JOIN m a ON a.name = clean_ref LEFT JOIN m b ON b.name = noisy_ref)
    SELECT pair_key, clean_ref, noisy_ref, CASE WHEN aq = bq THEN aq END AS quality, CASE WHEN aq <> bq THEN aq END AS clean_quality, CASE WHEN aq <> bq THEN bq END AS noisy_quality,
      CASE WHEN ax = bx THEN ax END AS toxic, CASE WHEN ax <> bx THEN ax END AS clean_toxic, CASE WHEN ax <> bx THEN bx END AS noisy_toxic FROM j""")
def _(t: Tables):
    p = t.read("documents").select(F.col("doc_id").alias("pair_key"), F.col("doc_id").cast(S).alias("clean_ref"), (F.col("doc_id") + 1).cast(S).alias("noisy_ref"))
    m = t.read("labels").select(F.col("doc_id").cast(S).alias("name"), "quality", "toxic")
    return J.pair_metadata_merge(p, m, ["quality", "toxic"], "clean_ref", "noisy_ref")


# exposures by order priority; the trailing number of a path is its index
EXPO = "ex AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN '10ms' WHEN '2-HIGH' THEN '50ms' WHEN '3-MEDIUM' THEN '500ms' WHEN '4-NOT SPECIFIED' THEN '2s' ELSE '10s' END AS exposure, o_orderkey % 1000 AS idx, o_orderkey FROM orders)"


def exposures(t: Tables):
    p = F.col("o_orderpriority")
    label = F.when(p == "1-URGENT", "10ms").when(p == "2-HIGH", "50ms").when(p == "3-MEDIUM", "500ms").when(p == "4-NOT SPECIFIED", "2s").otherwise("10s")
    return t.read("orders").select(label.alias("exposure"), (F.col("o_orderkey") % 1000).alias("idx"), "o_orderkey").withColumn(
        "path", F.concat("exposure", F.lit("/img_"), F.col("o_orderkey").cast(S)))


@query("pair_by_tail_index", f"""WITH {EXPO}, p AS (SELECT exposure, idx, min(exposure || '/img_' || o_orderkey) AS path FROM ex GROUP BY ALL)
    SELECT a.idx, a.path AS clean_path, b.path AS noisy_path FROM p a JOIN p b USING (idx) WHERE a.exposure = '2s' AND b.exposure = '10ms'""")
def _(t: Tables):
    e = exposures(t)
    return J.pair_by_tail_index(e.where("exposure = '2s'"), e.where("exposure = '10ms'"))


@query("exposure_pair_candidates", f"""WITH {EXPO}, d AS (SELECT DISTINCT exposure, CASE WHEN exposure LIKE '%ms' THEN replace(exposure, 'ms', '')::DOUBLE ELSE replace(exposure, 's', '')::DOUBLE * 1000 END AS k, idx FROM ex),
      n AS (SELECT exposure, count(*) AS n FROM d GROUP BY exposure),
      c AS (SELECT a.exposure AS noisy_exposure, b.exposure AS clean_exposure, a.idx FROM d a JOIN d b ON a.idx = b.idx AND a.k < b.k)
    SELECT noisy_exposure, clean_exposure, idx, common, noisy_count, clean_count, recommended FROM c JOIN (SELECT noisy_exposure, clean_exposure, count(*) AS common, any_value(x.n) AS noisy_count, any_value(y.n) AS clean_count,
      CASE WHEN count(*) >= 50 THEN 'yes' ELSE 'no' END AS recommended FROM c JOIN n x ON x.exposure = noisy_exposure JOIN n y ON y.exposure = clean_exposure GROUP BY noisy_exposure, clean_exposure) USING (noisy_exposure, clean_exposure)""")
def _(t: Tables):
    e = exposures(t).withColumn("sort_key", N.exposure_sort_key(F.col("exposure"), "dark"))
    return J.exposure_pair_candidates(e, 50)


@query("condition_lookup", "SELECT pair_key, model, e.folder, R4(psnr_gain) AS psnr_gain, R2(mean_signal) AS mean_signal FROM fx_eval e LEFT JOIN fx_cond c ON e.folder = c.folder")
def _(t: Tables):
    d = t.evals().join(t.conditions().select("folder", "mean_signal"), "folder", "left")
    return d.select("pair_key", "model", "folder", rnd("psnr_gain", 4).alias("psnr_gain"), rnd("mean_signal", 2).alias("mean_signal"))


PARTS = """
    ca AS (SELECT (c_custkey % 40)::BIGINT AS folder, count(*) AS customers FROM customer GROUP BY 1),
    cb AS (SELECT (s_suppkey % 60)::BIGINT AS folder, count(*) AS suppliers FROM supplier GROUP BY 1),
    cc AS (SELECT (p_partkey % 50)::BIGINT AS folder, count(*) AS parts FROM part GROUP BY 1)"""


def parts(t: Tables):
    g = lambda d, k, m, n: d.groupBy((F.col(k) % m).cast("bigint").alias("folder")).agg(F.count(F.lit(1)).alias(n))
    return [g(t.read("customer"), "c_custkey", 40, "customers"), g(t.read("supplier"), "s_suppkey", 60, "suppliers"),
            g(t.read("part"), "p_partkey", 50, "parts")]


@query("condition_assemble", f"WITH {PARTS} SELECT coalesce(ca.folder, cb.folder, cc.folder) AS folder, customers, suppliers, parts FROM ca FULL JOIN cb ON ca.folder = cb.folder FULL JOIN cc ON coalesce(ca.folder, cb.folder) = cc.folder")
def _(t: Tables):
    return J.condition_assemble(parts(t), "folder")


@query("condition_assemble_inner", f"WITH {PARTS} SELECT folder, customers, suppliers, parts FROM ca JOIN cb USING (folder) JOIN cc USING (folder)")
def _(t: Tables):
    return J.condition_assemble(parts(t), "folder", "inner")


@query("all_pairs_self", "SELECT a.folder AS folder_a, b.folder AS folder_b, R2(abs(a.mean_signal - b.mean_signal)) AS signal_distance FROM fx_cond a JOIN fx_cond b ON a.folder < b.folder")
def _(t: Tables):
    p = paired(t.conditions().select("folder", "mean_signal"), "folder", unordered=True)
    return p.select(F.col("a.folder").alias("folder_a"), F.col("b.folder").alias("folder_b"), rnd(F.abs(F.col("a.mean_signal") - F.col("b.mean_signal")), 2).alias("signal_distance"))


BENCH_CTE = """bw AS (SELECT item_id AS id, sha256(text) AS sha, list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda v: v <> '') AS w FROM benchmark),
    bs AS (SELECT id, sha, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM bw)"""


@query("cross_compare", f"""WITH {BENCH_CTE}, p AS (SELECT d.id AS candidate, b.id AS reference, count(*) AS n, any_value(d.n) AS nd, any_value(b.n) AS nb, any_value(d.sha = b.sha) AS same
      FROM (SELECT id, sha, len(s) AS n, unnest(s) AS g FROM fx_shingles) d JOIN (SELECT id, sha, len(s) AS n, unnest(s) AS g FROM bs) b ON d.g = b.g GROUP BY d.id, b.id)
    SELECT candidate, reference, R8(n::DOUBLE / nb) AS correlation, R8(n::DOUBLE / (nd + nb - n)) AS jaccard, same AS sha256_match FROM p WHERE n::DOUBLE / nb >= 0.8""")
def _(t: Tables):
    from pixelstrata.operators.text_similarity import contained_texts
    e = contained_texts(t.text_sets(), t.text_sets("benchmark", "item_id"), 0.8)
    return e.select("candidate", "reference", rnd("correlation", 8).alias("correlation"), rnd("jaccard", 8).alias("jaccard"), "sha256_match")


@query("lagged_frame_join", "SELECT a.folder, a.frame, l.lag::BIGINT AS lag, count(*) AS pixels, sum((a.dn - b.dn) * (a.dn - b.dn))::BIGINT AS squared FROM fx_frames a CROSS JOIN (VALUES (1), (4)) l(lag) JOIN fx_frames b ON a.folder = b.folder AND a.y = b.y AND a.x = b.x AND b.frame = a.frame + l.lag GROUP BY ALL")
def _(t: Tables):
    p = lag_pairs(t.pixels(), ["folder", "y", "x"], [1, 4], "dn")
    d = (F.col("a") - F.col("b")).cast("bigint")
    return p.groupBy("folder", "frame", "lag").agg(F.count(F.lit(1)).alias("pixels"), F.sum(d * d).alias("squared"))


@query("grid_completeness", """
    WITH a AS (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_suppkey FROM lineitem),
      g AS (SELECT * FROM (SELECT DISTINCT l_returnflag FROM a), (SELECT DISTINCT l_linestatus FROM a), (SELECT DISTINCT l_linenumber FROM a), (SELECT DISTINCT l_suppkey FROM a))
    SELECT (SELECT count(*) FROM g) AS expected, (SELECT count(*) FROM a) AS actual, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM a)) AS missing, CAST(0 AS BIGINT) AS extra""")
def _(t: Tables):
    return J.grid_completeness(t.read("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"])


SNAP = """
    fz AS (SELECT doc_id AS pair_key, sha256(text) AS sha, n_chars AS size FROM documents),
    nw AS (SELECT d.doc_id AS pair_key, CASE WHEN quality = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS sha, n_chars + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS size
           FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) = 0)"""


def snapshots(t: Tables):
    d = t.read("documents")
    frozen = d.select(F.col("doc_id").alias("pair_key"), F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("size"))
    j = d.join(t.read("labels"), "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    low = F.coalesce(F.col("quality") == 0, F.lit(False))
    now = j.select(F.col("doc_id").alias("pair_key"), F.sha2(F.when(low, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha"),
                   (F.col("n_chars") + low.cast("int")).alias("size"))
    return frozen, now


@query("snapshot_drift", f"""WITH {SNAP}
    SELECT pair_key, CASE WHEN nw.sha IS NULL THEN 'missing' WHEN fz.sha = nw.sha AND fz.size = nw.size THEN 'unchanged' ELSE 'changed' END AS status,
      CASE WHEN nw.sha IS NULL OR (fz.sha = nw.sha AND fz.size = nw.size) THEN '' ELSE 'sha;size' END AS changed_fields FROM fz LEFT JOIN nw USING (pair_key)""")
def _(t: Tables):
    return J.snapshot_drift(*snapshots(t), "pair_key", ["sha", "size"])


@query("recompute_consistency", """
    WITH a AS (SELECT folder, avg(v) AS f FROM (SELECT folder, y, x, var_samp(dn) AS v FROM fx_frames GROUP BY ALL) GROUP BY folder),
      b AS (SELECT folder, avg(v) AS s FROM (SELECT folder, y, x, (sum(dn * dn)::DOUBLE - sum(dn)::DOUBLE * sum(dn)::DOUBLE / count(*)) / (count(*) - 1) AS v FROM fx_frames GROUP BY ALL) GROUP BY folder)
    SELECT folder, R1(f) AS first, R1(s) AS second, abs(f - s) / greatest(abs(f), 1e-12) <= 1e-9 AS consistent FROM a JOIN b USING (folder)""")
def _(t: Tables):
    px = t.pixels_anywhere()
    a = temporal_maps(px).groupBy("folder").agg(F.avg("var1").alias("v"))
    s = px.groupBy("folder", "y", "x").agg(F.sum(F.col("dn") * F.col("dn")).cast("double").alias("q"), F.sum("dn").cast("double").alias("s"), F.count(F.lit(1)).alias("n"))
    b = s.groupBy("folder").agg(F.avg((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("v"))
    return J.recompute_consistency(a, b, ["folder"], "v", 1e-9).select("folder", rnd("first", 1).alias("first"), rnd("second", 1).alias("second"), "consistent")


@query("round_robin_assign", """
    WITH i AS (SELECT doc_id AS pair_key, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position FROM documents), c AS (SELECT folder, row_number() OVER (ORDER BY mean_signal, folder) - 1 AS slot FROM fx_cond)
    SELECT pair_key, position, folder AS condition_folder FROM i JOIN c ON position % (SELECT count(*) FROM c) = slot""")
def _(t: Tables):
    i = range_ordinals(t.read("documents").select(F.col("doc_id").alias("pair_key"), "n_chars"), [], ["n_chars", "pair_key"], "p")
    i = i.select("pair_key", (F.col("p") - 1).alias("position"))
    from pyspark.sql import Window as W
    c = t.conditions().select(F.col("folder").alias("condition_folder"), (F.row_number().over(W.partitionBy(F.lit(1)).orderBy("mean_signal", "folder")) - 1).cast("bigint").alias("slot"))
    return J.round_robin_assign(i, "position", c, "slot").select("pair_key", "position", "condition_folder")


PICKS = [0.1, 0.25, 0.5, 0.5, 0.9]


def greedy_sql() -> str:
    """The greedy choice written out: target k skips what targets 1..k-1 took."""
    out = ["it AS (SELECT doc_id AS id, n_chars::DOUBLE AS v, sha256(text) AS sha FROM documents)"]
    for k, q in enumerate(PICKS, 1):
        used = " AND ".join([f"id <> (SELECT id FROM g{i})" for i in range(1, k)]) or "true"
        out.append(f"t{k} AS (SELECT quantile_cont(v, {q}) AS t FROM it), g{k} AS (SELECT id, abs(v - t) AS d, t FROM it, t{k} WHERE {used} ORDER BY abs(v - t), sha, id LIMIT 1)")
    return ", ".join(out)


@query("nearest_quantile_pick", f"WITH {greedy_sql()} " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS selection_rank, {q}::DOUBLE AS quantile, R4(t) AS target, id, R4(d) AS distance FROM g{k}" for k, q in enumerate(PICKS, 1)))
def _(t: Tables):
    i = t.read("documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("v"), F.concat(F.sha2("text", 256), F.lpad(F.col("doc_id").cast(S), 20, "0")).alias("tie"))
    d = J.nearest_quantile_pick(i, "id", "v", "tie", PICKS)
    return d.select("selection_rank", "quantile", rnd("target", 4).alias("target"), "id", rnd("distance", 4).alias("distance"))


@query("role_tag_join", """
    WITH m AS (SELECT folder, avg(dn) AS v FROM fx_frames GROUP BY folder), r AS (SELECT (n_nationkey % 12)::BIGINT AS folder, CASE WHEN min(n_regionkey) % 2 = 0 THEN 'calibration' ELSE 'evaluation' END AS role FROM nation GROUP BY 1)
    SELECT coalesce(m.folder, r.folder) AS folder, R4(v) AS mean, role, CASE WHEN role IS NULL THEN 'role missing' WHEN v IS NULL THEN 'folder missing' ELSE '' END AS drift FROM m FULL JOIN r ON m.folder = r.folder""")
def _(t: Tables):
    m = t.pixels_anywhere().groupBy("folder").agg(F.avg("dn").alias("v")).select("folder", rnd("v", 4).alias("mean"))
    r = t.read("nation").groupBy((F.col("n_nationkey") % 12).cast("bigint").alias("folder")).agg(F.when(F.min("n_regionkey") % 2 == 0, "calibration").otherwise("evaluation").alias("role"))
    return J.role_tag_join(m, r, "folder")


# -- sources and sinks -----------------------------------------------------------------

def pair_csv(t: Tables) -> str:
    """A pair manifest written from the documents table, to be read back by the source."""
    path = fresh_path(t.spark, "pairs-csv")
    d = t.read("documents").select(
        F.col("doc_id").cast(S).alias("pair_key"), F.concat(F.lit("clean/"), F.col("doc_id").cast(S), F.lit(".tif")).alias("clean_path"),
        F.concat(F.lit("/abs/noisy/"), F.col("doc_id").cast(S), F.lit(".tif")).alias("noisy_path"), "lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"))
    d.write.option("header", True).csv(path)
    return path


@query("src_pair_manifest", """
    SELECT doc_id::VARCHAR AS pair_key, '/data/clean/' || doc_id || '.tif' AS clean_path, '/abs/noisy/' || doc_id || '.tif' AS noisy_path,
      'lang=' || lang || CASE WHEN doc_id % 3 <> 0 THEN ';source=' || source ELSE '' END AS metadata FROM documents""")
def _(t: Tables):
    m = N.load_pair_manifest(t.spark, pair_csv(t), "/data")
    return m.select("pair_key", "clean_path", "noisy_path", N.metadata_text().alias("metadata"))


@query("records_to_rows", """
    SELECT doc_id::VARCHAR AS pair_key, '/data/clean/' || doc_id || '.tif' AS clean_path, '/abs/noisy/' || doc_id || '.tif' AS noisy_path, lang, CASE WHEN doc_id % 3 <> 0 THEN source END AS source FROM documents""")
def _(t: Tables):
    return N.records_to_rows(N.load_pair_manifest(t.spark, pair_csv(t), "/data"), ["lang", "source"])


def split_text(t: Tables) -> str:
    """A split manifest (label quality -> documents) as text files."""
    path = fresh_path(t.spark, "splits-text")
    d = t.read("labels").select(F.concat(F.lit("q"), F.col("quality").cast(S)).alias("split"), F.col("doc_id").alias("pair_key"))
    d = ordinal_within(d, "split", ["pair_key"], F.floor(F.col("pair_key") / 65536), "ordinal")
    N.write_split_manifest(d.withColumn("ordinal", F.col("ordinal") - 1), path)
    return path


SPLIT_SQL = "sp AS (SELECT 'q' || quality AS split, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS ordinal, doc_id::VARCHAR AS pair_key FROM labels)"


@query("src_split_manifest", f"WITH {SPLIT_SQL} SELECT * FROM sp")
def _(t: Tables):
    return N.load_split_manifest(t.spark, split_text(t))


@query("split_resolve", f"WITH {SPLIT_SQL} SELECT pair_key, ordinal, CASE WHEN doc_id IS NOT NULL THEN '/data/clean/' || pair_key || '.tif' END AS clean_path, doc_id IS NOT NULL AS known FROM sp LEFT JOIN documents ON doc_id::VARCHAR = pair_key WHERE split = 'q1'")
def _(t: Tables):
    found, unknown = N.resolve_split(N.load_pair_manifest(t.spark, pair_csv(t), "/data"), N.load_split_manifest(t.spark, split_text(t)), "q1")
    found = found.select("pair_key", "ordinal", "clean_path", F.lit(True).alias("known"))
    return found.unionByName(unknown.select("pair_key", "ordinal", F.lit(None).cast(S).alias("clean_path"), F.lit(False).alias("known")))


@query("src_frame_listing", """
    WITH n AS (SELECT regexp_extract(path, '^[^/]*') AS folder, path, nullif(regexp_extract(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*/?$'), '/$', ''), '\\.[A-Za-z]+$', ''), '(\\d+)$', 1), '')::BIGINT AS k FROM fx_paths)
    SELECT folder, k AS frame_index, min(path) AS path, count(*) AS copies FROM n WHERE k IS NOT NULL GROUP BY folder, k""")
def _(t: Tables):
    return L.frame_listing(t.paths(), F.regexp_extract("path", "^[^/]*", 0), L.number_in(F.col("path"), "trailing"))


FRAMES_PER_STACK = 64


@query("src_frames_raw", "SELECT folder, frame, y - 2 AS y, x AS x, dn FROM fx_frames WHERE y >= 2 AND x < 6")
def _(t: Tables):
    from pixelstrata.operators.frames import explode_tiles
    tiles, stack = t.tiles(), F.floor((F.col("frame") - 1) / FRAMES_PER_STACK)
    base = fresh_path(t.spark, "raw-stacks")
    name = F.concat(F.col("folder").cast("string"), F.lit("/"), (stack * FRAMES_PER_STACK + 1).cast("string"), F.lit(raw_stacks.SUFFIX))
    raw_stacks.write_stacks(tiles.select(name.alias("path"), "frame", "dn"), base)
    d = raw_stacks.read_stacks(t.spark, base, 8, 8, roi=(2, 0, 6, 6))
    part = lambda k: F.regexp_extract("path", r"([0-9]+)/([0-9]+)\.raw$", k).cast("bigint")
    d = d.withColumn("folder", part(1)).withColumn("frame", part(2) + F.col("frame")).drop("path").withColumn("top", F.col("top") - 2)
    return explode_tiles(d).select("folder", "frame", "y", "x", "dn")


def setting_sql(section: int, token: str) -> str:
    """Number of a ``setting:number unit`` token in one section of the split line."""
    name, unit = token.split()
    return f"regexp_extract(p[{section}], '{name}:([-+]?[0-9]*\\.?[0-9]+){unit}', 1)::DOUBLE"


LOG_SQL = f"""
    lp AS (SELECT folder, event_id, string_split_regex(line, '\\s+(Exposure|Sync\\.A|Sync\\.B|gain)\\s') AS p FROM fx_log),
    lg AS (SELECT folder, event_id, trim(p[1]) AS filename, {setting_sql(2, 'delay ms')} AS exposure_delay_ms, {setting_sql(2, 'width ms')} AS exposure_width_ms, {setting_sql(3, 'delay ns')} AS sync_a_delay_ns,
        {setting_sql(3, 'width us')} AS sync_a_width_us, {setting_sql(4, 'delay ns')} AS sync_b_delay_ns, {setting_sql(4, 'width us')} AS sync_b_width_us, trim(p[5])::DOUBLE AS gain FROM lp WHERE len(p) = 5)"""


@query("src_acquisition_log", f"WITH {LOG_SQL} SELECT * FROM lg")
def _(t: Tables):
    return L.acquisition_log(t.log_lines(), ["folder", "event_id"])


@query("acquisition_constancy", f"""WITH {LOG_SQL}, s AS (SELECT folder, event_id, exposure_delay_ms || '|' || (gain % 1)::VARCHAR || '|' || sync_a_width_us AS setting, (gain > 75)::INT AS hi FROM lg),
    g AS (SELECT folder, count(*) AS lines, count(DISTINCT setting || hi) AS settings, min_by(setting || hi, event_id) AS first_setting FROM s GROUP BY folder)
    SELECT folder, lines, settings, first_setting, settings = 1 AS constant, (SELECT count(DISTINCT first_setting) = 1 FROM g) AS folders_identical FROM g""")
def _(t: Tables):
    log = L.acquisition_log(t.log_lines(), ["folder", "event_id"])
    f = lambda c: F.format_string("%.1f", F.col(c)) if isinstance(c, str) else F.format_string("%.1f", c)
    s = F.concat(F.concat_ws("|", f("exposure_delay_ms"), f(F.col("gain") % 1), f("sync_a_width_us")), (F.col("gain") > 75).cast("int").cast(S))
    return L.acquisition_constancy(log, s, "event_id")


LIST_SQL = """
    ln AS (SELECT event_id, CASE WHEN event_id % 20 = 0 THEN '# comment' ELSE 'a/' || ((event_id % 7 + 1) * 100) || 'ms/scene_' || lpad(user_id::VARCHAR, 4, '0') || '.png  b/' || (event_id % 3 + 1) || 's/scene_' ||
      lpad(CASE WHEN event_id % 11 = 0 THEN user_id + 1 ELSE user_id END::VARCHAR, 4, '0') || '.png' END AS line, (event_id % 7 + 1) * 100.0::DOUBLE AS lm, (event_id % 3 + 1) * 1000.0::DOUBLE AS rm, user_id FROM events)"""


def exposure_lines(t: Tables):
    e, u = F.col("event_id"), F.col("user_id")
    pad = lambda c: F.lpad(c.cast(S), 4, "0")
    line = F.concat(F.lit("a/"), ((e % 7 + 1) * 100).cast(S), F.lit("ms/scene_"), pad(u), F.lit(".png  b/"), (e % 3 + 1).cast(S), F.lit("s/scene_"),
                    pad(F.when(e % 11 == 0, u + 1).otherwise(u)), F.lit(".png"))
    return t.read("events").select("event_id", F.when(e % 20 == 0, "# comment").otherwise(line).alias("line"))


@query("src_exposure_list", f"""WITH {LIST_SQL}, o AS (SELECT *, split_part(line, '  ', 1) AS l, split_part(line, '  ', 2) AS r FROM ln WHERE line NOT LIKE '#%'),
    p AS (SELECT CASE WHEN lm >= rm THEN l ELSE r END AS clean_path, CASE WHEN lm >= rm THEN r ELSE l END AS noisy_path, greatest(lm, rm) AS clean_ms, least(lm, rm) AS noisy_ms FROM o)
    SELECT clean_path, noisy_path, count(*) AS rows, R4(clean_ms) AS clean_ms, R4(noisy_ms) AS noisy_ms, R6(clean_ms / noisy_ms) AS exposure_ratio,
      regexp_extract(clean_path, '([^/]*)\\.png', 1) || '__noisy_' || split_part(noisy_path, '/', 2) || '__clean_' || split_part(clean_path, '/', 2) AS pair_key,
      CASE WHEN regexp_extract(clean_path, '([^/]*)\\.png', 1) <> regexp_extract(noisy_path, '([^/]*)\\.png', 1) THEN 'stem mismatch' END AS problem
    FROM p GROUP BY ALL""")
def _(t: Tables):
    d = N.exposure_pairs(exposure_lines(t))
    g = d.groupBy("clean_path", "noisy_path", "clean_ms", "noisy_ms", "exposure_ratio", "pair_key", "problem").agg(F.count(F.lit(1)).alias("rows"))
    return g.select("clean_path", "noisy_path", "rows", rnd("clean_ms", 4).alias("clean_ms"), rnd("noisy_ms", 4).alias("noisy_ms"), rnd("exposure_ratio", 6).alias("exposure_ratio"), "pair_key", "problem")


@query("parse_exposure", """
    WITH l AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN round(value)::BIGINT || 'ms' WHEN 1 THEN round(value)::BIGINT || 's' WHEN 2 THEN 'dark' ELSE event_type END AS label, round(value) AS v FROM events)
    SELECT event_id, label, R4(CASE event_id % 4 WHEN 0 THEN v WHEN 1 THEN v * 1000 END) AS ms, R4(CASE event_id % 4 WHEN 0 THEN v WHEN 1 THEN v * 1000 WHEN 2 THEN -1 ELSE 1e12 END) AS sort_key FROM l""")
def _(t: Tables):
    e, v = F.col("event_id"), F.round("value").cast("bigint").cast(S)
    label = F.when(e % 4 == 0, F.concat(v, F.lit("ms"))).when(e % 4 == 1, F.concat(v, F.lit("s"))).when(e % 4 == 2, "dark").otherwise(F.col("event_type"))
    d = t.read("events").select("event_id", label.alias("label"))
    return d.select("event_id", "label", rnd(N.exposure_ms(F.col("label")), 4).alias("ms"), rnd(N.exposure_sort_key(F.col("label"), "dark"), 4).alias("sort_key"))


@query("split_scene_frame", """
    WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lang ELSE source || '_' || lpad(doc_id::VARCHAR, 6, '0') END AS stem FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN stem ELSE regexp_extract(stem, '^(.*)_(\\d+)$', 1) END AS scene, CASE WHEN doc_id % 5 = 0 THEN '' ELSE regexp_extract(stem, '^(.*)_(\\d+)$', 2) END AS frame FROM n""")
def _(t: Tables):
    i = F.col("doc_id")
    s, f = N.scene_frame(F.when(i % 5 == 0, F.col("lang")).otherwise(F.concat_ws("_", "source", F.lpad(i.cast(S), 6, "0"))))
    return t.read("documents").select("doc_id", s.alias("scene"), f.alias("frame"))


@query("src_metadata_csv", """
    WITH r AS (SELECT event_id, 'cam/' || event_type || '_' || (user_id % 100) || '.tif' AS filename, round(value * 100)::BIGINT AS gain FROM events),
      e AS (SELECT event_id, gain, unnest([regexp_extract(filename, '([^/]*)\\.tif', 1), regexp_extract(filename, '[^/]*$')]) AS name FROM r)
    SELECT name, arg_max(gain, event_id) AS gain FROM e GROUP BY name""")
def _(t: Tables):
    r = t.read("events").select("event_id", F.concat(F.lit("cam/"), "event_type", F.lit("_"), (F.col("user_id") % 100).cast(S), F.lit(".tif")).alias("filename"), F.round(F.col("value") * 100).cast("bigint").alias("gain"))
    return N.metadata_index(r, ["filename"], ["event_id"]).select("name", "gain")


@query("src_metric_glob", "SELECT variant, count(*) AS rows, sum(psnr_gain)::BIGINT AS total, true AS complete FROM fx_metrics GROUP BY variant")
def _(t: Tables):
    base = fresh_path(t.spark, "metrics")
    m = t.metrics().select("variant", "seed", "folder", "psnr_gain")
    for v in ("P-L", "P-H", "H-L", "H-H"):
        m.where(F.col("variant") == v).write.option("header", True).csv(f"{base}/{v}_seed1/real_eval")
    d = N.read_metric_glob(t.spark, f"{base}/*_seed*/real_eval/*.csv", "variant string, seed bigint, folder bigint, psnr_gain bigint", expected=4)
    return d.groupBy("variant").agg(F.count(F.lit(1)).alias("rows"), F.sum("psnr_gain").alias("total"), F.min("complete").alias("complete"))


@query("src_condition_tables", "SELECT folder, R2(mean_signal) AS mean_signal, R2(fano) AS fano FROM fx_cond")
def _(t: Tables):
    base = fresh_path(t.spark, "conditions")
    c = t.conditions()
    c.select(F.concat(F.col("folder").cast(S), F.lit(".0")).alias("folder"), "mean_signal").write.option("header", True).csv(f"{base}/signal")
    c.select("folder", "fano").write.option("header", True).csv(f"{base}/fano")
    d = N.read_condition_tables(t.spark, {"signal": f"{base}/signal", "fano": f"{base}/fano"})
    j = d["signal"].join(d["fano"], "folder")
    return j.select("folder", rnd(F.col("mean_signal").cast("double"), 2).alias("mean_signal"), rnd(F.col("fano").cast("double"), 2).alias("fano"))


@query("sink_csv_union", """
    SELECT 'customer' AS kind, c_custkey AS key, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT 'part', p_partkey, NULL, p_brand FROM part""")
def _(t: Tables):
    path = fresh_path(t.spark, "csv-union")
    a = t.read("customer").select(F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"))
    b = t.read("part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"))
    sinks.write_csv_union([a, b], ["kind", "key"], path)
    return N.read_table(t.spark, path, "kind string, key bigint, segment string, brand string")


@query("sink_json_strict", """
    WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 IN (0, 3) THEN NULL ELSE round(value * 100)::BIGINT END AS v FROM events)
    SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","value":' || coalesce(v || '.0', 'null') || '}' AS value FROM e WHERE coalesce(v, 0) < 10000000""")
def _(t: Tables):
    i = F.col("event_id")
    v = F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 7 == 3, F.lit(float("inf"))).otherwise(F.round(F.col("value") * 100))
    d = t.read("events").select(v.alias("value"), "event_type", "event_id")
    path = fresh_path(t.spark, "json-strict")
    sinks.write_json(d, path)
    back = t.spark.read.text(path)
    return back.select(F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), "value")


@query("sink_maps", "SELECT 'mean' AS map_name, folder, y, x, R4(mean) AS value FROM fx_maps UNION ALL SELECT 'std1', folder, y, x, R4(std1) FROM fx_maps")
def _(t: Tables):
    path = fresh_path(t.spark, "maps")
    sinks.write_maps(sinks.long_maps(temporal_maps(t.pixels_anywhere()), ["mean", "std1"]), path)
    d = t.spark.read.parquet(path)
    return d.select("map_name", F.col("folder").cast("bigint").alias("folder"), "y", "x", rnd("value", 4).alias("value"))
