"""Near-duplicate embeddings with a pivot-permutation index.

Reference points (pivots), about ``PIVOTS`` times the square root of the number of vectors,
are a bounded sample of vectors that lie apart from each other, filled up with random
directions where the sample is one dense group. Each vector is described by its nearest pivots in
order; inverted lists hold, for each pivot, the vectors that have it among their nearest.
Two vectors of a list that share at least ``SHARED`` of their nearest pivots are candidates,
and the exact cosine in double precision decides. A pair is counted in the list of the first
pivot that both have, so once. Lists are cut into blocks, compared block against block; links
leave a task as counts per vector and a spanning forest, never as all pairs.

Defined results: vectors that are null, zero, of another length than the most frequent one or
hold null or non-finite components link with nothing (n_links 0, own component). A row with
a null id takes part in nothing: component_id null, kept true. Rows of equal id are nodes of
their own for the counts and one node for the components. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pixelstrata.llm.tables import stored
from pixelstrata.operators.similarity import connected_components

PIVOTS = 2.0
NEAREST = 10
SHARED = 3
APART = 0.7  # cosine that two sampled pivots stay below
BLOCK = 1024


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with a vector of the most frequent length whose components are all finite and not all zero, as doubles."""
    v = F.transform(column, lambda x: x.cast("double"))
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(column, lambda x: x != 0)
    rows = vectors.where(F.col(column).isNotNull() & F.coalesce(good, F.lit(False)))
    length = rows.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size(column) == (length["n"] if length else 0)).withColumn(column, v)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _listed(vectors: DataFrame, pivots: np.ndarray, nearest: int, kind: str) -> DataFrame:
    """row, pivot, near (all nearest pivots in order), vector: one row for each of the nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit(matrix(batch.column(1)))
            order = np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)
            at = pa.array(np.repeat(np.arange(len(v)), order.shape[1]))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(order.reshape(-1)), lists(order).take(at), lists(v).take(at)], names=["row", "pivot", "near", "vector"])

    return vectors.select("row", "embedding").mapInArrow(run, f"row {kind}, pivot int, near array<int>, vector array<double>")


def spread_pivots(sample: np.ndarray, wanted: int, seed: int = 3) -> np.ndarray:
    """Sampled vectors with pairwise cosines below ``APART``, filled up with random directions."""
    chosen: list[np.ndarray] = []
    for v in unit(sample):
        if not chosen or (np.stack(chosen) @ v).max() < APART:
            chosen.append(v)
    rest = np.random.default_rng(seed).normal(size=(max(0, wanted - len(chosen)), sample.shape[1]))
    return np.concatenate([np.stack(chosen), unit(rest)]) if len(rest) else np.stack(chosen)


def _forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with the edges x[k], y[k]."""
    above: dict[int, int] = {}

    def root(a):
        while (b := above.setdefault(a, a)) != a:
            above[a] = above[b] if b in above else b
            a = b
        return a

    out = []
    for a, b in zip(x.tolist(), y.tolist()):
        u, v = root(a), root(b)
        if u != v:
            above[max(u, v)] = min(u, v)
            out.append((a, b))
    return out


def _compared(pdf: pd.DataFrame, cosine: float, shared: int) -> pd.DataFrame:
    """Links inside one block of a list, or between two: rows (row, other, n); other is null for a count."""
    p, own = int(pdf["pivot"].iloc[0]), pdf["own"].to_numpy()
    near = np.stack(pdf["near"].to_numpy())
    names, bit = np.unique(near, return_inverse=True)
    bit = bit.reshape(near.shape)
    mask = np.zeros((len(pdf), len(names) // 64 + 1), np.uint64)  # nearest pivots as bits, in the order of the pivots
    for k in range(near.shape[1]):
        mask[np.arange(len(pdf)), bit[:, k] // 64] |= np.uint64(1) << (bit[:, k] % 64).astype(np.uint64)
    p = int(np.searchsorted(names, p))
    v = np.stack(pdf["vector"].to_numpy())
    first = own == own.min()
    left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if not first.all() else (np.arange(len(pdf)),) * 2
    both = np.zeros((len(left), len(right)), np.int16)
    before = np.zeros((len(left), len(right)), bool)
    for w in range(mask.shape[1]):
        common = mask[left, w][:, None] & mask[right, w][None]
        both += np.bitwise_count(common).astype(np.int16)
        lower = np.uint64(0xFFFFFFFFFFFFFFFF) if w < p // 64 else (np.uint64(1) << np.uint64(p % 64)) - np.uint64(1) if w == p // 64 else np.uint64(0)
        before |= (common & lower) != 0
    wanted = (both >= shared) & ~before
    if first.all():
        wanted = np.triu(wanted, 1)
    x, y = np.nonzero(wanted)
    linked = np.zeros(len(x), bool)
    if len(x) > len(left) * len(right) // 8:
        linked = (v[left] @ v[right].T)[x, y] >= cosine
    else:
        for k in range(0, len(x), 1 << 16):
            a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            linked[k : k + len(a)] = np.einsum("ij,ij->i", v[left[a]], v[right[b]]) >= cosine
    x, y = left[x[linked]], right[y[linked]]
    row = pdf["row"].to_numpy()
    n = np.bincount(np.concatenate([x, y]), minlength=len(pdf)) if len(x) else np.zeros(len(pdf), int)
    some = np.flatnonzero(n)
    edges = _forest(x, y)
    return pd.DataFrame(
        {"row": np.concatenate([row[some], row[[a for a, _ in edges]]]), "other": pd.array([*[None] * len(some), *row[[b for _, b in edges]].tolist()], "Int64"), "n": np.concatenate([n[some], np.zeros(len(edges), int)])}
    )


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, pivots: float = PIVOTS, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding)``."""
    # rows get numbers of their own, so repeated ids stay apart
    numbered = stored(vectors.select("vec_id", "embedding").withColumn("row", F.monotonically_increasing_id()), "pivot-vectors")
    good = stored(usable(numbered.where("vec_id is not null")), "pivot-usable")
    total = good.count()
    wanted = max(nearest, math.ceil(pivots * math.sqrt(total)))
    sample = good.orderBy(F.xxhash64("row"), "row").limit(wanted).select("embedding").toPandas()  # bounded: a few times sqrt(rows)
    if total < 2:
        counts = components = None
    else:
        points = spread_pivots(np.stack(sample["embedding"].to_numpy()), wanted)
        listed = stored(_listed(good, points, min(nearest, len(points)), "bigint"), "pivot-lists")
        sizes = listed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))  # one row per pivot
        rows = listed.join(F.broadcast(sizes), "pivot").withColumn("own", F.pmod(F.xxhash64("row", "pivot"), F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("parts", "other")
        need = min(shared, len(points))
        found = stored(rows.groupBy("pivot", "a", "b").applyInPandas(lambda pdf: _compared(pdf, cosine, need), "row bigint, other bigint, n bigint"), "pivot-links")
        counts = found.where("other is null").groupBy("row").agg(F.sum("n").alias("n_links"))
        ids = numbered.select("row", "vec_id")
        edges = found.where("other is not null").select("row", "other").distinct()
        edges = edges.join(ids.withColumnRenamed("vec_id", "a"), "row").join(ids.select(F.col("row").alias("other"), F.col("vec_id").alias("b")), "other").select("a", "b")
        edges = stored(edges, "pivot-edges")
        touched = edges.select(F.col("a").alias("vec_id")).union(edges.select("b")).distinct()
        components = connected_components(touched, edges, key="vec_id")
    out = numbered.select("row", "vec_id")
    out = out.join(counts, "row", "left") if counts is not None else out.withColumn("n_links", F.lit(None).cast("bigint"))
    out = out.join(components, "vec_id", "left") if components is not None else out.withColumn("component", F.lit(None).cast("bigint"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
