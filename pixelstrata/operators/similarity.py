"""Similar contents: exact threshold joins, clusters and representatives.

Two unit vectors with correlation >= t lie within e = sqrt(2 (1 - t)). After a
fixed rotation the dimensions are cut into blocks; by the pigeonhole principle a
close pair is within e / sqrt(blocks) in at least one block. Cells of that size
turn the comparison into an equi-join that loses no pair; candidates are then
checked exactly. Exact copies are folded onto one representative beforehand, so
a large group of copies costs one row, not all its pairs.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelstrata.functions.scalars import array_sum, let
from pixelstrata.sources.storage import cut_lineage


def unit_vector(values: Column, n: int) -> Column:
    """Mean removed and scaled to length one; a constant vector becomes all zeros."""
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    scale = lambda c: let(F.sqrt(square(c)), lambda q: F.transform(c, lambda v: F.when(q > 1e-12, F.try_divide(v, q)).otherwise(F.lit(0.0))))
    return let(
        F.transform(values, lambda v: v.cast("double")),
        lambda d: let(array_sum(d) / n, lambda m: let(F.transform(d, lambda v: v - m), scale)))


def _profiles(texts, n: int):
    """Unit vectors of the character counts of some texts, one row each."""
    import numpy as np

    c = np.stack([np.bincount(np.frombuffer((t or "").encode("utf-32-le"), dtype="<u4") % n, minlength=n) for t in texts])
    c = c - c.sum(axis=1, keepdims=True) / n
    norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-12, c / np.maximum(norm, 1e-12), 0.0)


def character_profile(texts: DataFrame, key: str, text: str, n: int = 64) -> DataFrame:
    """(id, vec): unit vectors of the counts of all characters of the whole text, by code point modulo n."""
    kind = dict(texts.dtypes)[key]

    def run(batches):
        for pdf in batches:
            for s in range(0, len(pdf), HASHED):
                part = pdf.iloc[s:s + HASHED]
                yield pd.DataFrame({"id": part[key].to_numpy(), "vec": list(_profiles(part[text], n))})

    return texts.select(key, text).mapInPandas(run, f"id {kind}, vec array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def representatives(vectors: DataFrame, key: str = "id", vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """(one row per distinct vector, copies as (representative, copy) star edges)."""
    reps = vectors.groupBy(vec).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
    many = reps.where(F.col("copies") > 1).select(vec, F.col(key).alias("a"))
    star = vectors.join(many, vec).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))
    return reps.select(key, vec, "copies"), star


def _cells(vectors: DataFrame, key: str, vec: str, n: int, blocks: int, radius: float, home: bool) -> DataFrame:
    """(cell, key, c0.., n0..): the cell of every block (home) or all cells its ball may touch.

    c are the block's coordinates, n the norms of all blocks: both bound the distance from below.
    """
    import numpy as np

    size = 1 << max(1, math.ceil(math.log2(n)))  # rotation needs a power of two: pad with zeros
    h = np.array([[1.0]])
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    h /= math.sqrt(size)
    per = size // blocks
    delta = radius / math.sqrt(blocks) * (1 + 1e-9) + 1e-12
    width = 2 * delta
    kind = dict(vectors.dtypes)[key]
    mult = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

    def expand(ids, vecs) -> pd.DataFrame:
        m = np.zeros((len(vecs), size))
        m[:, :n] = np.stack(vecs)
        r = (m @ h).reshape(len(vecs), blocks, per)
        lo, hi = np.floor((r - delta) / width).astype(np.int64), np.floor((r + delta) / width).astype(np.int64)
        mid = np.floor(r / width).astype(np.int64)
        norms = np.sqrt((r * r).sum(axis=2)).astype(np.float32)
        frames = []
        for combo in [0] if home else range(1 << per):
            pick = ((combo >> np.arange(per)) & 1).astype(bool)
            cell = mid if home else np.where(pick, hi, lo)
            # a ball inside one cell along a chosen dimension would repeat another combination
            fresh = ~(pick & (lo == hi)).any(axis=2)
            code = (cell.astype(np.uint64) * mult[np.arange(per) % 4] + np.arange(per, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
            code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            code += np.arange(blocks, dtype=np.uint64)[None, :] * np.uint64(0x94D049BB133111EB)
            row, blk = np.nonzero(fresh)
            cols = {f"c{i}": r[row, blk, i] for i in range(per)} | {f"n{i}": norms[row, i] for i in range(blocks)}
            frames.append(pd.DataFrame({"cell": code[row, blk].view(np.int64), key: ids[row], **cols}))
        return pd.concat(frames, ignore_index=True)

    def run(batches):
        step = 512  # vectors per output piece: bounds the expansion in memory
        for pdf in batches:
            ids, vecs = pdf[key].to_numpy(), pdf[vec].to_numpy()
            for s in range(0, len(pdf), step):
                yield expand(ids[s:s + step], list(vecs[s:s + step]))

    coords = ", ".join([f"c{i} double" for i in range(per)] + [f"n{i} float" for i in range(blocks)])
    # every vector grows to many cell rows: spread small inputs over all tasks first
    spark = vectors.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return vectors.select(key, vec).repartition(parts, key).mapInPandas(run, f"cell bigint, {key} {kind}, {coords}")


def similar_between(left: DataFrame, right: DataFrame, threshold: float, n: int, blocks: int = 16, ordered: bool = False) -> DataFrame:
    """(a, b, corr) of all left / right vectors with correlation >= threshold, without loss.

    ``ordered`` keeps a < b only (self join). Inputs: (id, vec) unit vectors.
    """
    e = math.sqrt(2 * (1 - threshold))
    q = _cells(left, "id", "vec", n, blocks, e, home=False)
    h = _cells(right, "id", "vec", n, blocks, e, home=True)
    dims = [c for c in q.columns if c[0] in "cn" and c[1:].isdigit()]
    q = q.withColumnsRenamed({"id": "a", **{c: f"q{c}" for c in dims}})
    h = h.withColumnsRenamed({"id": "b", **{c: f"h{c}" for c in dims}})
    gap = lambda k: sum(((F.col(f"q{c}") - F.col(f"h{c}")) * (F.col(f"q{c}") - F.col(f"h{c}")) for c in dims if c[0] == k), F.lit(0.0))
    near = (gap("c") <= e * e / blocks * (1 + 1e-6) + 1e-12) & (gap("n") <= e * e * (1 + 1e-3) + 1e-5)
    c = q.join(h, "cell")
    if ordered:
        c = c.where(F.col("a") < F.col("b"))
    c = c.where(near).select("a", "b").distinct()
    va, vb = left.select(F.col("id").alias("a"), F.col("vec").alias("_va")), right.select(F.col("id").alias("b"), F.col("vec").alias("_vb"))
    scored = c.join(va, "a").join(vb, "b").select("a", "b", dot("_va", "_vb").alias("corr"))
    return scored.where(F.col("corr") >= threshold)


def similar_pairs(vectors: DataFrame, threshold: float, n: int, blocks: int = 16) -> DataFrame:
    """Near duplicates: pairs of distinct vectors above the threshold and star edges to exact copies."""
    vectors = cut_lineage(vectors.select("id", "vec"))  # read six times below
    reps, star = representatives(vectors)
    reps = cut_lineage(reps)
    near = similar_between(reps, reps, threshold, n, blocks, ordered=True).withColumn("kind", F.lit("near_content"))
    return near.unionByName(star.select("a", "b", F.lit(1.0).alias("corr"), F.lit("exact_copy").alias("kind")))


def connected_components(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(key, component): smallest member of each connected component.

    Alternates large-star and small-star steps (each two joins on node ids, no
    neighbour lists) until the edge set stops changing: O(log^2 n) rounds.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    e = cut_lineage(e)
    before = None
    while True:
        # large star: link every larger neighbour of u to the smallest neighbour of u
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = sym.join(m, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: link every smaller neighbour of u, and u, to the smallest of them
        m2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(m2, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(m2.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    label = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", key)
    return nodes.select(key).join(label, key, "left").select(key, F.coalesce("component", F.col(key)).alias("component"))


def cluster_summary(labels: DataFrame, key: str = "id") -> DataFrame:
    """Members with the size of their cluster."""
    n = labels.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size"))
    return labels.join(n, "component").select(key, "component", "cluster_size")


def medoids(labels: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Member with the highest mean similarity over its edges, per cluster (lowest id on ties)."""
    sym = edges.select(F.col("a").alias(key), "corr").unionByName(edges.select(F.col("b").alias(key), "corr"))
    score = sym.groupBy(key).agg(F.avg("corr").alias("score"))
    d = labels.join(score, key, "left").select(key, "component", F.coalesce(F.round("score", 9), F.lit(0.0)).alias("score"))
    g = d.groupBy("component").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(key).alias("i"))).alias("_m"), F.count(F.lit(1)).alias("cluster_size"))
    return g.select("component", F.col("_m.i").alias("medoid"), (-F.col("_m.s")).alias("score"), "cluster_size")


HASHED = 256  # images that a worker transforms at a time


def _cosine_hash(side: int):
    """Hashes of a stack of square images: low 8 x 8 cosine coefficients against their median (first row left out of the median)."""
    import numpy as np

    i = np.arange(side)
    basis = np.cos(np.pi * (2 * i[None, :] + 1) * i[:, None] / (2 * side)) * math.sqrt(2 / side)
    basis[0] /= math.sqrt(2)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)[::-1]

    def hashes(a):
        c = (basis @ a @ basis.T)[:, :8, :8]
        med = np.median(c[:, 1:, :].reshape(len(c), -1), axis=1)
        return ((c.reshape(len(c), -1) > med[:, None]) * weights).sum(axis=1, dtype=np.uint64).view(np.int64)

    return hashes


def perceptual_hash(images: DataFrame, keys: list[str], vec: str, side: int) -> DataFrame:
    """64-bit hash of each image: low 8 x 8 cosine coefficients against their median."""
    import numpy as np

    types, hashes = dict(images.dtypes), _cosine_hash(side)

    def run(batches):
        for pdf in batches:
            for s in range(0, len(pdf), HASHED):
                part = pdf.iloc[s:s + HASHED]
                yield part[keys].assign(phash=hashes(np.stack(part[vec].to_numpy()).reshape(-1, side, side)))

    return images.select(*keys, vec).mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", phash bigint")


def text_hash(texts: DataFrame, key: str, text: str, side: int) -> DataFrame:
    """(id, phash): perceptual hash of the character profile of each whole text; profiles stay in their task."""
    kind, hashes = dict(texts.dtypes)[key], _cosine_hash(side)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s in range(0, batch.num_rows, HASHED):
                part = batch.slice(s, HASHED)
                c = _profiles(part.column(1).to_pylist(), side * side)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes(c.reshape(-1, side, side)))], names=["id", "phash"])

    return texts.select(key, text).mapInArrow(run, f"id {kind}, phash bigint")
