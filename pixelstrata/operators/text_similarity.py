"""Similar texts by what the whole text says: exact copies by hash, near copies by shingle sets.

Exact copies share the SHA-256 of the text and are folded to one representative first, so a
large group of copies costs one row and gives star edges. Near pairs have a Jaccard
similarity of their word shingle sets at or above a threshold and are found without loss:
under one order of all shingles, rare ones first, two sets that are similar enough share a
shingle among the first few of each (prefix filter), early enough in both that the rest can
still make up the overlap (position filter). The order comes from counts by hash bucket, a
table that grows with the shingles up to a fixed size; any order loses nothing, a good one
makes few candidates. The full sets decide; only those of candidates are shuffled. Sets are
larger than their texts, so ``Texts`` forms them again in each pass instead of storing them.

Where only groups are wanted, ``linked_texts`` compares every text with the first of each of
its prefix shingles, and then only texts that are still in different groups: a dense group
costs one row a member, not all its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelstrata.functions import byte_spans
from pixelstrata.operators.similarity import connected_components
from pixelstrata.sources.storage import cut_lineage

BUCKET_BITS = 26  # shingle counts kept for the order: one byte for each shingle or two, 2**26 bytes at most
BLOCK_BITS = 16  # buckets counted by one call
SLICE = 1 << 18  # bytes of text, or shingles, that a worker handles at a time
SENT_IDS = 500_000  # ids of copies or candidates that may go to all tasks


def spread(df: DataFrame) -> DataFrame:
    """A table of few partitions dealt over all tasks, before work that is heavy per row."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def _lists(sizes, flat) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def text_sets(texts: DataFrame, key: str, text: str, width: int = 3) -> DataFrame:
    """(id, sha, shingles): distinct word shingles of each whole text.

    Words lie between blanks and the control characters from tab to carriage return. A text of
    fewer words is one shingle; a null or empty one has none.
    """
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_spans.slices(batch.column(1), SLICE):
                hashes, _, _, counts = byte_spans.words(part, lower=False)
                made, sizes = byte_spans.shingles(hashes, counts, width)
                sets = [np.unique(made[b - n:b]) for b, n in zip(np.cumsum(sizes), sizes)]
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                sha = [hashlib.sha256(part.raw[a:b].tobytes()).hexdigest() for a, b in zip(part.starts, part.ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(sets)), pa.array(sha, pa.string()), _lists([len(x) for x in sets], flat)], names=["id", "sha", "shingles"])

    return spread(texts.select(key, text)).mapInArrow(run, f"id {kind}, sha string, shingles array<bigint>")


def _by_id(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose id is (left_semi) or is not (left_anti) among others; up to ``SENT_IDS`` of these are sent to the rows."""
    ids = cut_lineage(ids.select("id"))
    return df.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "id", how)


@dataclass
class Texts:
    """Texts (id, text) whose shingle sets are formed where they are read: writing the sets takes twice the texts' own size."""

    rows: DataFrame
    width: int = 3

    def sets(self) -> DataFrame:
        return text_sets(self.rows, "id", "text", self.width)

    def hashes(self) -> DataFrame:
        return self.rows.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))

    def shingle_bound(self) -> int:
        """About as many as there are shingles; the texts are not cut for it."""
        return (self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4

    def only(self, ids: DataFrame, how: str) -> Texts:
        return Texts(_by_id(self.rows, ids, how), self.width)


def _sets(source: Texts | DataFrame) -> DataFrame:
    return source.sets() if isinstance(source, Texts) else source


def _only(source: Texts | DataFrame, ids: DataFrame, how: str) -> Texts | DataFrame:
    return source.only(ids, how) if isinstance(source, Texts) else _by_id(source, ids, how)


def _held(source: Texts | DataFrame) -> Texts | DataFrame:
    """Given sets are written once, as nothing says what forming them costs."""
    return source if isinstance(source, Texts) else cut_lineage(source)


def copies(source: Texts | DataFrame) -> tuple[Texts | DataFrame, DataFrame]:
    """(one row per distinct text, star edges (a, b) from the first to every other copy)."""
    sets = source.hashes() if isinstance(source, Texts) else source
    first = sets.groupBy("sha").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("copies"))
    star = cut_lineage(sets.select("sha", "id").join(first.where("copies > 1").select("sha", "a"), "sha").where("id <> a").select("a", F.col("id").alias("b")))
    return _only(source, star.select(F.col("b").alias("id")), "left_anti"), star


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / (F.size(a) + F.size(b) - both)


def _pieces(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, values, ends of the rows in them) of pieces of a list column of about ``SLICE`` values."""
    past = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
    values, a = np.asarray(column.flatten()), 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(past, past[a] + SLICE, "right")) - 1)
        yield a, values[past[a]:past[b]], past[a + 1:b + 1] - past[a]
        a = b


def order_bits(shingles: int) -> int:
    return min(BUCKET_BITS, max(BLOCK_BITS, int(shingles).bit_length() - 1))


def bucket_counts(sets: DataFrame, bits: int | None = None) -> np.ndarray:
    """How many shingles fall into each hash bucket, as a byte that rises with the number and is the number up to 127.

    Tasks send two bytes a shingle, dealt by blocks of buckets; the driver gets a byte a bucket.
    """
    if bits is None:
        total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
        bits = order_bits(total)
    mask, block = np.int64((1 << bits) - 1), 1 << BLOCK_BITS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values, _ in _pieces(batch.column(0)):
                k = np.sort(values & mask)
                low, home = (k & (block - 1)).astype(np.uint16), k >> BLOCK_BITS
                found, at = np.unique(home, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([x.tobytes() for x in np.split(low, at[1:])] if len(found) else [], pa.binary())], names=["block", "low"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        n = sum(np.bincount(np.frombuffer(x, np.uint16), minlength=block) for x in rows["low"])
        code = np.where(n < 128, n, np.minimum(255, 127 + np.floor(8 * np.log2(np.maximum(n, 1) / 127))))
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "n": [code.astype(np.uint8).tobytes()]})

    dealt = sets.select("shingles").where(F.size("shingles") > 0).mapInArrow(deal, "block bigint, low binary")
    found = dealt.groupBy("block").applyInPandas(count, "block bigint, n binary").toArrow()
    out = np.zeros(1 << bits, np.uint8)
    for b, n in zip(found["block"], found["n"]):
        out[b.as_py() * block:(b.as_py() + 1) * block] = np.frombuffer(n.as_py(), np.uint8)
    return out


def rare_first(sets: DataFrame, counts: np.ndarray, take: Callable[[int], int], least: int) -> DataFrame:
    """(id, n, token, pos): the first ``take(n)`` of a set's n shingles in the common order, rare ones first.

    Shingles whose bucket holds fewer than ``least`` are left out: nothing can meet them.
    """
    kind, mask = dict(sets.dtypes)["id"], np.int64(len(counts) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, values, past in _pieces(batch.column(1)):
                rows, sizes, tokens, places = [], [], [], []
                for r, b in enumerate(past):
                    s = values[(past[r - 1] if r else 0):b]
                    weight = counts[s & mask]
                    first = np.lexsort((s, weight))[:take(len(s))]
                    at = np.flatnonzero(weight[first] >= least)
                    rows.append(np.full(len(at), start + r))
                    sizes.append(np.full(len(at), len(s)))
                    tokens.append(s[first[at]])
                    places.append(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows), pa.int64())), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (sizes, tokens, places))], names=["id", "n", "token", "pos"])

    return sets.select("id", "shingles").where(F.size("shingles") > 0).mapInArrow(run, f"id {kind}, n bigint, token bigint, pos bigint")


def prefixes(reps: Texts | DataFrame, threshold: float) -> DataFrame:
    """The part of each set that a set of at least this similarity must meet."""
    bits = order_bits(reps.shingle_bound()) if isinstance(reps, Texts) else None
    sets = _sets(reps)
    return rare_first(sets, bucket_counts(sets, bits), lambda n: n - math.ceil(threshold * n - 1e-9) + 1, 2)


def _may_reach(threshold: float) -> Column:
    """Sizes fit, and the shared shingle at (pos, pos2) leaves enough behind it in both sets, if it is their first common one."""
    fits = F.least("n", "n2") >= F.lit(threshold) * F.greatest("n", "n2") - 1e-9
    needed = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n2")) - 1e-9)
    return fits & (F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= needed)


def _other(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"id": "id2", "n": "n2", "pos": "pos2"})


def candidate_pairs(reps: Texts | DataFrame, threshold: float) -> DataFrame:
    """(a, b): distinct texts that may be similar enough; no pair that is goes missing."""
    rows = cut_lineage(prefixes(reps, threshold))
    met = rows.join(_other(rows), "token").where((F.col("id") < F.col("id2")) & _may_reach(threshold))
    return met.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def _scored(pairs: DataFrame, reps: Texts | DataFrame, threshold: float) -> DataFrame:
    pairs = cut_lineage(pairs)
    used = _sets(_only(reps, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "left_semi"))
    side = lambda s: used.select(F.col("id").alias(s), F.col("shingles").alias(f"s{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("corr")).where(F.col("corr") >= threshold)


def linked_texts(source: Texts | DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges that connect just the texts which near pairs and copies connect, few to a dense group.

    Every text meets the smallest id of each of its prefix shingles, where that may be similar
    enough. A pair that is similar enough shares a prefix shingle, so it is either in one group
    after that, or it is among the pairs of different groups that are compared next.
    """
    reps, star = copies(_held(source))
    rows = cut_lineage(prefixes(reps, threshold))
    first = rows.groupBy("token").agg(F.min(F.struct("id", "n", "pos")).alias("m"))
    met = rows.join(first.select("token", F.col("m.id").alias("id2"), F.col("m.n").alias("n2"), F.col("m.pos").alias("pos2")), "token")
    stars = met.where((F.col("id") != F.col("id2")) & _may_reach(threshold)).select(F.col("id2").alias("a"), F.col("id").alias("b")).distinct()
    found = cut_lineage(_scored(stars, reps, threshold).select("a", "b"))
    group = connected_components(rows.select("id").distinct(), found)
    placed = cut_lineage(rows.join(group, "id"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    placed = placed.join(mixed, "token", "left_semi")
    across = placed.join(_other(placed).withColumnRenamed("component", "component2"), "token").where((F.col("component") < F.col("component2")) & _may_reach(threshold))
    pairs = across.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    return found.unionByName(_scored(pairs, reps, threshold).select("a", "b")).unionByName(star)


def within_clusters(source: Texts | DataFrame, labels: DataFrame) -> Texts | DataFrame:
    """Sets of the members of clusters of two or more."""
    several = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return _only(source, labels.join(several, "component"), "left_semi")


def similar_texts(source: Texts | DataFrame, threshold: float) -> DataFrame:
    """(a, b, corr, kind): near pairs of distinct texts (corr = Jaccard) and star edges to exact copies."""
    reps, star = copies(_held(source))
    return near_texts(reps, threshold).withColumn("kind", F.lit("near_content")).unionByName(star.select("a", "b", F.lit(1.0).alias("corr"), F.lit("exact_copy").alias("kind")))


def near_texts(reps: Texts | DataFrame, threshold: float) -> DataFrame:
    """(a, b, corr) of distinct texts at or above the threshold."""
    return _scored(candidate_pairs(reps, threshold), reps, threshold)


def contained_texts(candidates: DataFrame, references: DataFrame, share: float) -> DataFrame:
    """(candidate, reference, correlation, jaccard, sha256_match): references of whose shingles a candidate has at least ``share``.

    A candidate that has enough of a reference has one of any few of its shingles; those that
    are rarest among the candidates are looked up, so what many texts share makes no candidate.
    """
    candidates, references = cut_lineage(candidates), cut_lineage(references)
    wanted = rare_first(references, bucket_counts(candidates), lambda n: n - math.ceil(share * n - 1e-9) + 1, 1)
    wanted = wanted.select(F.col("id").alias("reference"), "token")
    met = candidates.select(F.col("id").alias("candidate"), F.explode("shingles").alias("token")).join(wanted, "token").select("candidate", "reference").distinct()
    c = candidates.select(F.col("id").alias("candidate"), F.col("sha").alias("sha_c"), F.col("shingles").alias("c"))
    r = references.select(F.col("id").alias("reference"), F.col("sha").alias("sha_r"), F.col("shingles").alias("r"))
    both = F.size(F.array_intersect("c", "r")).cast("double")
    rows = met.join(c, "candidate").join(r, "reference").select("candidate", "reference", (both / F.size("r")).alias("correlation"), jaccard(F.col("c"), F.col("r")).alias("jaccard"), (F.col("sha_c") == F.col("sha_r")).alias("sha256_match"))
    return rows.where(F.col("correlation") >= share)
