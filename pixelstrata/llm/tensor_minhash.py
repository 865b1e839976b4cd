"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full shingle sets.

Each document gets two sides of m small collections of ``ROWS`` minhashes. A table of the
index is a pair (left collection i, right collection j) and its key combines the two, so
m * m tables cost 2 * m * ROWS minhashes instead of m * m * 2 * ROWS. m follows from the
threshold and the probability ``miss`` with which one side may fail a pair at the threshold.

Steps: sketch every text; fold equal sets to one class; drop classes whose left or right
collections meet nobody (they can't meet in any table); link table members with the table's
smallest member; verify on full sets; components. Members of tables that still hold several
components are then compared in blocks, so no link between different sets is lost and no
table's pairs become rows.

Defined results: null and empty texts have no shingles, link with nothing and are their own
component. Rows with equal doc_id are one node. A null doc_id takes part in nothing: its
component_id is null and kept is true. An empty table gives an empty result. Further columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pixelstrata.functions import byte_spans as B
from pixelstrata.llm.tables import stored
from pixelstrata.operators.similarity import connected_components

ROWS = 3
BLOCK = 256  # members of a table compared with as many others in one step
PACK = 400  # rows that share a Python group


def collections_per_side(percent: int, miss: float) -> int:
    s = (percent / 100) ** ROWS
    return max(2, math.ceil(math.log(miss) / math.log(1 - s))) if s < 1 else 2


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1).view(np.int64)))


def _sets(part: B.Slice, width: int) -> list[np.ndarray]:
    hashes, _, _, counts = B.words(part)
    made, sizes = B.shingles(hashes, counts, width)
    ends = np.cumsum(sizes)
    return [np.unique(made[b - n : b]) for b, n in zip(ends, sizes)]


def sketches(documents: DataFrame, width: int, side: int, seed: int = 7) -> DataFrame:
    """doc_id, n_shingles, digest of the set, left and right collection keys (null without shingles)."""
    spread = np.random.default_rng(seed).integers(0, 1 << 63, (2 * side * ROWS, 2), dtype=np.uint64)
    turn, odd = spread[:, 0], spread[:, 1] * np.uint64(2) + np.uint64(1)
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch.column(1)):
                sets = _sets(part, width)
                size = np.array([len(u) for u in sets])
                full = np.flatnonzero(size)
                keys = np.zeros((len(sets), 2 * side), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[r] for r in full])
                    at = np.cumsum(size[full]) - size[full]
                    for c in range(2 * side):
                        key = np.full(len(full), c + 1, np.uint64)
                        for k in range(c * ROWS, (c + 1) * ROWS):
                            key = B.mix(key + np.minimum.reduceat((flat ^ turn[k]) * odd[k], at))
                        keys[full, c] = key
                digest = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None for u in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(sets)), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), _lists(keys[:, :side].copy()), _lists(keys[:, side:].copy())],
                    names=["doc_id", "n_shingles", "digest", "lefts", "rights"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, lefts array<bigint>, rights array<bigint>")


def full_sets(documents: DataFrame, width: int) -> DataFrame:
    """rep, shingles (sorted)."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch.column(1)):
                sets = _sets(part, width)
                at = np.concatenate([[0], np.cumsum([len(u) for u in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(sets)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], names=["rep", "shingles"])

    return documents.select("doc_id", "text").mapInArrow(run, f"rep {kind}, shingles array<bigint>")


def _meeting(classes: DataFrame, side: str) -> DataFrame:
    """Classes that share a collection key of one side with another class."""
    long = classes.select("rep", F.posexplode(side).alias("i", "key"))
    shared = long.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "key")
    return long.join(shared, ["i", "key"]).select("rep").distinct()


def _star(live: DataFrame, percent: int) -> DataFrame:
    """(a, b): every member of a table with the table's smallest member, sizes permitting."""
    key = F.explode(F.flatten(F.transform("lefts", lambda x, i: F.transform("rights", lambda y, j: F.xxhash64(i, x, j, y))))).alias("key")
    rows = live.select("rep", "n", key)
    pivot = rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pairs = rows.join(pivot, "key").where("rep <> p.rep")
    fits = 100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")
    return pairs.where(fits).select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    sb = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    sa = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb")).alias("both")
    scored = pairs.join(sb, "b").join(sa, "a").select("a", "b", both, (F.size("sa") + F.size("sb")).alias("total"))
    return scored.where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select("a", "b")


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets x[k] and y[k]; by a blocked matrix product where many sets meet."""
    if len(x) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y)])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = seen[col] > 1
    row, col = row[again], (np.cumsum(seen > 1) - 1)[col[again]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total, wide = np.zeros((len(sets), len(sets)), np.float32), 8192
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        a, b = np.searchsorted(col, [c, c + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[row[a:b], col[a:b] - c] = 1
        total += m @ m.T
    return total[x, y].astype(np.int64)


def _block_links(rows: pd.DataFrame, percent: int) -> list[tuple]:
    """Links between different components among the members of one table block."""
    i, part = int(rows["i"].iloc[0]), rows["own"].to_numpy()
    lefts, rights = np.stack(rows["lefts"].to_numpy()), np.stack(rows["rights"].to_numpy())
    n, comp, rep = rows["n"].to_numpy(), rows["comp"].to_numpy(), rows["rep"].to_numpy()
    x, y = np.triu_indices(len(rows), 1)
    ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
    if (part != part[0]).any():
        ok &= part[x] != part[y]
    x, y = x[ok], y[ok]
    ok = (rights[x] == rights[y]).any(1) & ((lefts[x] == lefts[y]).argmax(1) == i)  # meet in a table, first seen here
    x, y = x[ok], y[ok]
    if not len(x):
        return []
    used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    sets = [np.asarray(s) for s in rows["shingles"].iloc[used]]
    both = _common(sets, at[: len(x)], at[len(x) :])
    linked = 100 * both >= percent * (n[x] + n[y] - both)
    label = {c: c for c in comp}

    def root(c):
        while label[c] != c:
            label[c] = label[label[c]]
            c = label[c]
        return c

    out = []
    for a, b in zip(x[linked], y[linked]):
        u, v = root(comp[a]), root(comp[b])
        if u != v:
            label[max(u, v)] = min(u, v)
            out.append((u, v))
    return out


def _rest(live: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """(a, b): components joined by links that no star has shown."""
    long = live.join(labels, "rep").select("rep", "comp", "n", "lefts", "rights", F.posexplode("lefts").alias("i", "key"))
    mixed = long.groupBy("i", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi")
    rows = long.join(mixed.select("i", "key", F.ceil(F.col("c") / BLOCK).alias("parts")), ["i", "key"])
    own = F.pmod(F.xxhash64("rep", "key"), "parts").cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    block = F.xxhash64("i", "key", F.least("own", "other"), F.greatest("own", "other"))
    rows = stored(rows.withColumn("block", block).drop("key", "parts", "other"), "minhash-rest")
    groups = max(1, math.ceil(rows.count() / PACK))
    rows = rows.join(sets, "rep").withColumn("pack", F.pmod("block", F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [p for _, g in pdf.groupby("block", sort=False) for p in _block_links(g.reset_index(drop=True), percent)]
        return pd.DataFrame(out, columns=["a", "b"]).astype({"a": pdf["comp"].dtype, "b": pdf["comp"].dtype})

    return rows.groupBy("pack").applyInPandas(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, miss: float = 2e-5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents(doc_id, text)``."""
    kind = dict(documents.dtypes)["doc_id"]
    sketch = stored(sketches(documents, width, collections_per_side(percent, miss)), "minhash-sketch")
    known = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("lefts").alias("lefts"), F.first("rights").alias("rights"))
    classes = stored(classes, "minhash-classes")
    live = stored(classes.join(_meeting(classes, "lefts"), "rep", "left_semi").join(_meeting(classes, "rights"), "rep", "left_semi").drop("digest"), "minhash-live")
    texts = documents.select("doc_id", "text").join(live.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = stored(full_sets(texts, width).dropDuplicates(["rep"]), "minhash-sets")
    links = stored(_confirmed(_star(live, percent), sets, percent), "minhash-links")
    labels = connected_components(live.select("rep").distinct(), links, key="rep").withColumnRenamed("component", "comp")
    labels = stored(labels, "minhash-labels")
    more = stored(_rest(live, labels, sets, percent, kind), "minhash-more")
    merged = connected_components(labels.select("comp").distinct(), more, key="comp")
    final = labels.join(merged, "comp").select("rep", "component")
    by_set = classes.join(final, "rep", "left").groupBy("digest").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(by_set, "digest", "left")
    out = out.select("doc_id", "n_shingles", alone.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that stay: one of each group, the one with the smallest doc_id.

    Of several rows with that id one stays; rows with a null id stay.
    """
    marks = near_duplicates(documents, width, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    named = documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    return named.join(marks, "doc_id", "left_semi").select(documents.columns).unionByName(documents.where("doc_id is null"))
