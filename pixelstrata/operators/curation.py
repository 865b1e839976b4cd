"""Dataset identity, duplicates, splits and leakage (first part: map alignment)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelstrata.functions.ordering import add_bounded_quantiles
from pixelstrata.functions.scalars import corr_agg, safe_div


def map_alignment(maps: DataFrame, dark: DataFrame, n: int) -> DataFrame:
    """Agreement of a dark map under seven square symmetries with each folder's median map."""
    y, x, m = F.col("y"), F.col("x"), n - 1
    moves = {"identity": (y, x), "flip_x": (y, m - x), "flip_y": (m - y, x), "rot90": (m - x, y), "rot180": (m - y, m - x), "rot270": (x, m - y), "transpose": (x, y)}
    arr = F.array(*[F.struct(F.lit(k).alias("transform"), a.alias("y"), b.alias("x")) for k, (a, b) in moves.items()])
    t = dark.select("dark", F.explode(arr).alias("t")).select("dark", "t.*")
    j = maps.join(t, ["y", "x"])
    k = ["folder", "transform"]
    px = j.groupBy(*k).agg(corr_agg("dark", "median").alias("pixel_correlation"))
    def line(axis: str, name: str) -> DataFrame:
        p = j.groupBy(*k, axis).agg(F.avg("dark").alias("d"), F.avg("median").alias("m"))
        return p.groupBy(*k).agg(corr_agg("d", "m").alias(name))
    q = add_bounded_quantiles(add_bounded_quantiles(j, k, "dark", {"_qd": 0.9}), k, "median", {"_qm": 0.9})
    a, b = F.col("dark") >= F.col("_qd"), F.col("median") >= F.col("_qm")
    jac = q.groupBy(*k).agg(safe_div(F.sum((a & b).cast("int")), F.sum((a | b).cast("int"))).alias("outlier_jaccard"))
    out = px.join(line("y", "row_correlation"), k).join(line("x", "column_correlation"), k).join(jac, k)
    w = W.partitionBy("folder").orderBy(F.round("pixel_correlation", 9).desc(), "transform")
    return out.withColumn("best", F.row_number().over(w) == 1)


def index_gaps(observed: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Gaps (gap_first, gap_last) of each folder in an expected (or the observed) range, with its counts on every row.

    A folder without a gap gives one row with null gap. Neighbours are found inside chunks of
    the range and between chunks, so a long folder is never expanded or sorted as a whole.
    """
    chunk = 4096
    d = observed.select("folder", "idx").distinct()
    span = d.groupBy("folder").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count(F.lit(1)).alias("present"))
    span = span.withColumn("lo", F.lit(first) if first is not None else F.col("lo")).withColumn("hi", F.lit(last) if last is not None else F.col("hi"))
    within = d.join(span, "folder").withColumn("_in", F.col("idx").between(F.col("lo"), F.col("hi")))
    unexpected = within.where(~F.col("_in")).groupBy("folder").agg(F.count(F.lit(1)).alias("unexpected"))
    ends = span.select("folder", F.explode(F.array(F.col("lo") - 1, F.col("hi") + 1)).alias("idx"))
    marks = within.where("_in").select("folder", "idx").unionByName(ends).withColumn("_c", F.floor(F.col("idx") / chunk))
    later = marks.groupBy("folder", "_c").agg(F.min("idx").alias("_m")).withColumn("_later", F.lead("_m").over(W.partitionBy("folder").orderBy("_c"))).drop("_m")
    following = F.lead("idx").over(W.partitionBy("folder", "_c").orderBy("idx"))
    gaps = marks.withColumn("_n", following).join(later, ["folder", "_c"]).withColumn("_n", F.coalesce("_n", "_later")).where(F.col("_n") > F.col("idx") + 1)
    gaps = gaps.select("folder", (F.col("idx") + 1).alias("gap_first"), (F.col("_n") - 1).alias("gap_last"))
    missing = gaps.groupBy("folder").agg(F.sum(F.col("gap_last") - F.col("gap_first") + 1).alias("missing"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return span.join(missing, "folder", "left").join(unexpected, "folder", "left").join(gaps, "folder", "left").select(
        "folder", "lo", "hi", "present", zero("missing"), zero("unexpected"), "gap_first", "gap_last")


def folder_integrity(frames: DataFrame, limits: dict[str, float], expected: int | None = None) -> DataFrame:
    """Counts of damaged frames per folder and PASS / FAIL with flags.

    Input per frame: (folder, frame, size, shape, zero_ratio, saturation_ratio, fingerprint).
    """
    from pixelstrata.functions.scalars import flag_list

    # sizes repeat heavily: the exact median comes from their counts
    med = frames.groupBy("folder").agg(F.percentile("size", 0.5).alias("_med"))
    shape = frames.groupBy("folder", "shape").agg(F.count(F.lit(1)).alias("n")).groupBy("folder").agg(F.max(F.struct("n", "shape")).alias("_s"))
    j = frames.join(med, "folder").join(shape, "folder")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    g = j.groupBy("folder").agg(
        F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        n(F.col("shape") != F.col("_s.shape")).alias("shape_mismatch"),
        n((F.col("_med") > 0) & (F.abs(F.col("size") - F.col("_med")) / F.col("_med") > limits["size"])).alias("size_outliers"),
        n(F.col("zero_ratio") > limits["zero"]).alias("excess_zero"), n(F.col("saturation_ratio") > limits["saturation"]).alias("excess_saturation"))
    # duplicates: count per fingerprint first, so one hot fingerprint is one row
    dup = frames.groupBy("folder", "fingerprint").agg((F.count(F.lit(1)) - 1).alias("d")).groupBy("folder").agg(F.sum("d").alias("duplicates"))
    want = F.lit(expected) if expected is not None else F.col("last_frame") - F.col("first_frame") + 1
    g = g.join(dup, "folder").withColumn("missing", F.greatest(want - F.col("frames"), F.lit(0)).cast("bigint"))
    flags = flag_list(*[(c, F.col(c) > 0) for c in ("missing", "shape_mismatch", "size_outliers", "excess_zero", "excess_saturation", "duplicates")])
    return g.withColumn("warning_flags", flags).withColumn("gate", F.when(F.col("warning_flags") == "", "PASS").otherwise("FAIL"))


def exact_duplicates(items: DataFrame, key: str, digest: str) -> DataFrame:
    """Copies as star edges: every further key of a hash with the group's first key and size."""
    g = items.groupBy(digest).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > 1)
    return items.select(digest, F.col(key).alias("other_key")).join(g, digest).where(F.col("other_key") != F.col("first_key")).select(
        digest, "first_key", "other_key", "group_size")


def hash_bucket(key, seed: int):
    """Stable position in [0, 1] from the first 12 hex digits of sha1(seed:key)."""
    hexa = F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), key)), 1, 12)
    return F.conv(hexa, 16, 10).cast("bigint").cast("double") / float(16 ** 12 - 1)


def hash_split(items: DataFrame, group_key: str, train: float, val: float, seed: int) -> DataFrame:
    """train / val / test by the hash of the split unit."""
    b = hash_bucket(F.col(group_key), seed)
    return items.withColumn("bucket", b).withColumn(
        "split", F.when(F.col("bucket") < train, "train").when(F.col("bucket") < train + val, "val").otherwise("test"))


def split_group_key(fields: list[str], fallback: str):
    """field=value parts of the non-empty fields joined by '|', else the pair key."""
    parts = F.concat_ws("|", *[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.concat(F.lit(f + "="), F.col(f).cast("string"))) for f in fields])
    return F.when(parts == "", F.col(fallback).cast("string")).otherwise(parts)


def content_seed(digest, condition, base: int):
    """Seed in [0, 2^32): low four of the first eight digest bytes of sha256(hash|condition|base)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", digest, condition, F.lit(str(base))), 256), 9, 8), 16, 10).cast("bigint")


def split_leakage(items: DataFrame, splits: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """One row of leakage counts and PASS / FAIL.

    ``items``: (key, sha, path, scene); ``splits``: (key, split); ``edges``: similar (a, b).
    """
    def one(d: DataFrame) -> DataFrame:
        return d.withColumn("_k", F.lit(1))

    n = F.count(F.lit(1))
    several = lambda c: items.join(splits, key).groupBy(c).agg((F.min("split") != F.max("split")).alias("x")).where("x").agg(n.alias(f"cross_split_{c}"))
    parts = [
        splits.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(n.alias("duplicate_membership")),
        items.join(splits, key, "left_anti").agg(n.alias("unassigned")),
        splits.join(items, key, "left_anti").agg(n.alias("unknown")),
        several("sha"), several("path"), several("scene"),
    ]
    from pixelstrata.operators.joins import cross_split_edges

    parts.append(cross_split_edges(edges, splits.withColumnRenamed(key, "pair_key")).agg(n.alias("near_cross")))
    out = one(parts[0])
    for p in parts[1:]:
        out = out.join(one(p), "_k")
    cols = ["duplicate_membership", "unassigned", "unknown", "cross_split_sha", "cross_split_path", "cross_split_scene", "near_cross"]
    bad = sum((F.col(c) for c in cols), F.lit(0))
    return out.select(*cols, F.when(bad == 0, "PASS").otherwise("FAIL").alias("status"))


def lofo_manifests(frames: DataFrame, block: int, input_offset: int, target_offsets: list[int]) -> DataFrame:
    """Frame roles of every leave-one-folder-out fold.

    ``frames``: (folder, frame). Blocks of the training and validation folders give
    one input and disjoint target frames; the held-out folder gives reference
    frames (first half) and test inputs (second half). Validation is the next folder,
    cyclically. The result holds folders x frames rows: folds come from an equi-join
    on the folder number.
    """
    from pixelstrata.functions.resampling import numbered

    counts = frames.groupBy("folder").agg(F.max("frame").alias("_max"))
    f = numbered(counts, "folder").select("folder", "_max", (F.col("_i") - 1).alias("pos"), F.col("_n").alias("n"))
    folds = f.select("folder", "_max", "pos", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("fold_pos"))
    names = f.select(F.col("pos").alias("fold_pos"), F.col("folder").alias("fold"))
    r = folds.join(names, "fold_pos").withColumn(
        "split", F.when(F.col("pos") == F.col("fold_pos"), "test").when(F.col("pos") == (F.col("fold_pos") + 1) % F.col("n"), "val").otherwise("train"))
    d = frames.select("folder", "frame").join(r.select("fold", "folder", "_max", "split"), "folder")
    offset = (F.col("frame") - 1) % block
    whole = (F.floor((F.col("frame") - 1) / block) + 1) * block <= F.col("_max")
    role = F.when(F.col("split") == "test", F.when(F.col("frame") <= F.floor(F.col("_max") / 2), "reference_member").otherwise("input")).when(
        whole & (offset == input_offset), "input").when(whole & offset.isin(target_offsets), "target_member")
    blk = F.concat(F.lit("folder_"), F.col("folder").cast("string"), F.lit("_block_"), F.lpad((F.floor((F.col("frame") - 1) / block) + 1).cast("string"), 2, "0"))
    key = F.when(role == "reference_member", "test_reference").when(F.col("split") == "test", F.concat(F.lit("test_frame_"), F.col("frame").cast("string"))).otherwise(blk)
    src = F.concat(F.lit("folder_"), F.col("folder").cast("string"), F.lit("_frame_"), F.col("frame").cast("string"))
    return d.select("fold", src.alias("source_key"), "folder", F.col("frame").alias("frame_index"), "split", role.alias("role"), key.alias("pair_key")).where(
        F.col("role").isNotNull())


def lofo_leakage(roles: DataFrame) -> DataFrame:
    """(fold, error, rows): violations of fold isolation; empty when all folds are clean.

    A fold's held-out folder is ``fold``; ``validation`` is its next folder.
    """
    n = F.count(F.lit(1)).alias("rows")
    tag = lambda d, e: d.agg(n).select("fold", F.lit(e).alias("error"), "rows")
    reused = tag(roles.groupBy("fold", "source_key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").groupBy("fold"), "source reused")
    held = tag(roles.where((F.col("folder") == F.col("fold")) & (F.col("split") != "test")).groupBy("fold"), "held-out folder outside test")
    overlap = tag(roles.groupBy("fold", "folder").agg((F.min("split") != F.max("split")).alias("x")).where("x").groupBy("fold"), "folder in several splits")
    t = roles.where(F.col("split") == "test").groupBy("fold", "source_key").agg(
        F.max((F.col("role") == "input").cast("int")).alias("i"), F.max((F.col("role") == "reference_member").cast("int")).alias("r"))
    leak = tag(t.where("i = 1 AND r = 1").groupBy("fold"), "test input inside the reference")
    return reused.unionByName(held).unionByName(overlap).unionByName(leak)


def role_validation(roles: DataFrame, allowed: list[str], forbidden: str, frozen: DataFrame, pairs: DataFrame) -> DataFrame:
    """Conflict counts of a source-role table and the size its isolation matrix must have."""
    k = lambda d: d.withColumn("_k", F.lit(1))
    n = F.count(F.lit(1))
    a = roles.agg(n.alias("sources"), F.sum((~F.col("role").isin(allowed)).cast("bigint")).alias("invalid_role"),
                  F.sum((F.col("role") == forbidden).cast("bigint")).alias("unauthorized_role"))
    dup = roles.groupBy("source").agg(n.alias("c")).where("c > 1").agg(n.alias("duplicate_source"))
    drift = roles.join(frozen.select("source", F.col("role").alias("_f")), "source").where(F.col("role") != F.col("_f")).agg(n.alias("frozen_mismatch"))
    p = pairs.agg(n.alias("isolation_pairs"))
    out = k(a).join(k(dup), "_k").join(k(drift), "_k").join(k(p), "_k").drop("_k")
    return out.withColumn("expected_pairs", F.floor(F.col("sources") * (F.col("sources") - 1) / 2)).withColumn(
        "isolation_complete", F.col("isolation_pairs") == F.col("expected_pairs"))


def isolation_matrix(roles: DataFrame) -> DataFrame:
    """Every unordered source pair with a rule-based decision (source tables are small and checked).

    Input: (source, role, device).
    """
    from pixelstrata.functions.resampling import paired

    p = paired(roles.select("source", "role", "device"), "source", unordered=True)
    a, b = F.col("a"), F.col("b")
    rule = (
        F.when((a["role"] == "excluded") | (b["role"] == "excluded"), F.struct(F.lit("blocking").alias("risk"), F.lit("EXCLUDED-SOURCE").alias("decision")))
        .when(a["device"] == b["device"], F.struct(F.lit("high").alias("risk"), F.lit("SAME-FAMILY-NOT-ISOLATED").alias("decision")))
        .when(a["role"] != b["role"], F.struct(F.lit("low").alias("risk"), F.lit("DATASET-LEVEL-ISOLATED").alias("decision")))
        .otherwise(F.struct(F.lit("high").alias("risk"), F.lit("DO-NOT-CROSS-USE").alias("decision"))))
    return p.select(a["source"].alias("source_a"), b["source"].alias("source_b"), rule["risk"].alias("risk"), rule["decision"].alias("decision"))


def calibration_overlap(rows: DataFrame, folder: str, used: str, value: str) -> DataFrame:
    """Folders used for estimation and evaluation and the value range of each role."""
    by = rows.groupBy(folder).agg(*[F.max((F.col(used) == r).cast("int")).alias(r) for r in ("calibration", "evaluation")],
                                  F.min(value).alias("lo"), F.max(value).alias("hi"))
    return by.select(folder, (F.col("calibration") == 1).alias("in_calibration"), (F.col("evaluation") == 1).alias("in_evaluation"),
                     ((F.col("calibration") == 1) & (F.col("evaluation") == 1)).alias("overlap"), "lo", "hi")


def source_inventory(files: DataFrame) -> DataFrame:
    """Files, bytes, kinds and first / last path per source. Input: (source, path, size, kind)."""
    return files.groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_distinct("kind").alias("kinds"),
        F.min("size").alias("smallest"), F.max("size").alias("largest"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def scene_relationship(thumbs: DataFrame, same: float = 0.95, same_gradient: float = 0.8, related: float = 0.45, related_gradient: float = 0.35) -> DataFrame:
    """Thumbnail and gradient correlation of folder pairs -> SAME / RELATED / UNKNOWN.

    Input: one (folder, image vector, gradient vector) row per folder; vectors centred to unit length.
    """
    from pixelstrata.functions.resampling import paired
    from pixelstrata.operators.similarity import dot

    p = paired(thumbs, "folder", unordered=True)
    c, g = dot("a.vec", "b.vec"), dot("a.grad", "b.grad")
    d = p.select(F.col("a.folder").alias("folder_a"), F.col("b.folder").alias("folder_b"), c.alias("correlation"), g.alias("gradient_correlation"))
    status = F.when((F.col("correlation") >= same) & (F.col("gradient_correlation") >= same_gradient), "SAME").when(
        (F.col("correlation") >= related) | (F.col("gradient_correlation") >= related_gradient), "RELATED").otherwise("UNKNOWN")
    return d.withColumn("status", status)


def route_gates(integrity: DataFrame, stability: DataFrame, references: DataFrame, limits: dict[str, float]) -> DataFrame:
    """PASS / WARN gates per folder with a reason text.

    Inputs by folder: gate; local_drift, fixed_correlation, residual_correlation; reference_delta, sign_agreement.
    """
    j = integrity.select("folder", "gate").join(stability, "folder").join(references, "folder")
    local, fixed = F.col("local_drift") <= limits["local_drift"], F.col("fixed_correlation") >= limits["fixed"]
    resid = F.abs("residual_correlation") <= limits["residual"]
    ref = F.col("sign_agreement") & (F.col("reference_delta") <= limits["reference"])
    p = lambda c: F.when(F.coalesce(c, F.lit(False)), "PASS").otherwise("WARN")
    reasons = F.concat_ws("; ", F.when(~local, "local drift too large"), F.when(~fixed, "fixed map not stable"),
                          F.when(~resid, "frame residuals correlated"), F.when(~ref, "reference sensitive"))
    d = j.select(
        "folder", F.col("gate").alias("integrity"), p(local & resid).alias("scene_stability"), p(fixed).alias("noise_characterization"),
        p(ref & local).alias("surrogate_reference"), p(ref & local & (F.col("gate") == "PASS")).alias("denoising_validation"), reasons.alias("reason"))
    return d.withColumn("reason", F.when(F.col("reason") == "", "usable").otherwise(F.col("reason"))).withColumn(
        "overall", F.when(F.col("integrity") == "PASS", "WARN").otherwise("FAIL"))


def pair_similarity_parts(pairs: DataFrame, vectors: DataFrame, high: float, high_ssim: float) -> DataFrame:
    """Full, centre, low-, high-frequency and gradient correlation and centre SSIM of given (a, b, corr) pairs of 8 x 8 contents.

    A pair is highly similar when its full similarity, its centre correlation or its centre SSIM is high.
    """
    from pixelstrata.functions.scalars import corr_from_moments
    from pixelstrata.operators.similarity import dot

    idx = F.sequence(F.lit(0), F.lit(63))
    at = lambda v, i: F.element_at(v, (i + 1).cast("int"))

    def low(v):
        corner = lambda i: F.floor(i / 16) * 16 + F.floor((i % 8) / 2) * 2
        return F.transform(idx, lambda i: (at(v, corner(i)) + at(v, corner(i) + 1) + at(v, corner(i) + 8) + at(v, corner(i) + 9)) / 4)

    def gradient(v):
        right = lambda i: F.when(i % 8 == 7, F.lit(0.0)).otherwise(F.abs(F.try_element_at(v, (i + 2).cast("int")) - at(v, i)))
        down = lambda i: F.when(i >= 56, F.lit(0.0)).otherwise(F.abs(F.try_element_at(v, (i + 9).cast("int")) - at(v, i)))
        return F.transform(idx, lambda i: right(i) + down(i))

    p = vectors.select("id", "vec", low(F.col("vec")).alias("lo"), gradient(F.col("vec")).alias("gr"))
    centre = F.array(*[F.lit(8 * r + c + 1) for r in range(2, 6) for c in range(2, 6)])
    p = p.withColumn("hi", F.zip_with("vec", "lo", lambda a, b: a - b)).withColumn("roi", F.transform(centre, lambda i: F.element_at("vec", i)))
    side = lambda s: p.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("lo", "hi", "gr", "roi")])
    j = pairs.join(side("a"), "a").join(side("b"), "b")

    def moments(c: str, n: int):
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
        var = lambda v: F.greatest(dot(v, v) / n - mean(v) * mean(v), F.lit(0.0))
        return mean(a), mean(b), dot(a, b) / n - mean(a) * mean(b), var(a), var(b)

    def corr(c: str, n: int = 64):
        return corr_from_moments(*moments(c, n)[2:])

    ma, mb, cov, va, vb = moments("roi", 16)
    c1, c2 = 0.01**2, 0.03**2  # stabilisers for contents of unit range
    ssim = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    d = j.select("a", "b", F.col("corr").alias("full_correlation"), corr("roi", 16).alias("center_correlation"), ssim.alias("center_ssim"), corr("lo").alias("low_correlation"), corr("hi").alias("high_correlation"),
                 corr("gr").alias("gradient_correlation"))
    return d.withColumn("high_similarity", (F.col("full_correlation") >= high) | (F.coalesce("center_correlation", F.lit(0.0)) >= high) | (F.col("center_ssim") >= high_ssim))


def source_independence(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Exact and near matches of every source with contents of other sources.

    ``members``: (id, source).
    """
    s = lambda c: members.select(F.col("id").alias(c), F.col("source").alias(f"s{c}"))
    e = edges.join(s("a"), "a").join(s("b"), "b").where(F.col("sa") != F.col("sb"))
    both = e.select(F.explode(F.array("sa", "sb")).alias("source"), "corr", "kind")
    g = both.groupBy("source").agg(
        F.sum((F.col("kind") == "exact_copy").cast("bigint")).alias("exact_matches"), F.sum((F.col("kind") == "near_content").cast("bigint")).alias("near_matches"),
        F.max("corr").alias("max_correlation"))
    n = members.groupBy("source").agg(F.count(F.lit(1)).alias("files"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return n.join(g, "source", "left").select("source", "files", zero("exact_matches"), zero("near_matches"), "max_correlation", F.col("max_correlation").isNull().alias("independent"))


def cluster_profiles(labels: dict[str, DataFrame]) -> DataFrame:
    """Cluster counts per threshold profile and whether all profiles agree on the number."""
    out = None
    for name, d in labels.items():
        n = d.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        g = n.agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"), F.sum((F.col("n") == 1).cast("bigint")).alias("singletons")).select(
            F.lit(name).alias("profile"), "clusters", "largest", "singletons")
        out = g if out is None else out.unionByName(g)
    w = W.partitionBy(F.lit(1))
    return out.withColumn("stable", F.min("clusters").over(w) == F.max("clusters").over(w))


def similarity_matrix(edges: DataFrame, members: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Symmetric matrix of edge counts between groups (one column per listed group)."""
    s = lambda c: members.select(F.col("id").alias(c), F.col(group).alias(f"g{c}"))
    e = edges.join(s("a"), "a").join(s("b"), "b")
    both = e.select(F.col("ga").alias(group), F.col("gb").alias("_o")).unionByName(e.select(F.col("gb").alias(group), F.col("ga").alias("_o")))
    return both.groupBy(group).agg(*[F.sum((F.col("_o") == v).cast("bigint")).alias(v) for v in values])
