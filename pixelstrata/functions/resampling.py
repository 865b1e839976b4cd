"""Deterministic resampling and bounded pairing of small (condition-level) tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_index(parts: list[Column], n: Column) -> Column:
    """Reproducible pseudo-random index in [0, n): first 8 hex digits of md5 over ':'-joined parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds 1-based ``_i`` in key order and the row count ``_n``.

    Meant for tables with a row per condition (folder, source, strategy), not per frame.
    """
    w = W.partitionBy(F.lit(1))
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(key)))


def paired(df: DataFrame, key: str, unordered: bool) -> DataFrame:
    """Rows (a, b): a before b, or every a with every other b; the pairs are the result.

    Partners are found by an equi-join on the row number, never by a cross join.
    """
    d = numbered(df, key)
    row = F.struct(*df.columns)
    last = F.col("_i") - 1 if unordered else F.col("_n")
    right = d.where(F.col("_i") > 1) if unordered else d
    right = right.select(row.alias("b"), F.col("_i").alias("_ib"), F.explode(F.sequence(F.lit(1), last.cast("int"))).alias("_i"))
    out = d.select(row.alias("a"), "_i").join(right, "_i")
    return out.where(F.col("_i") != F.col("_ib")).select("a", "b")


def bootstrap_means(df: DataFrame, keys: list[str], unit: str, value: str, rounds: int, seed: int) -> DataFrame:
    """Mean of ``rounds`` resamples of the units of each group (few units per group).

    The draw of unit i in round b is md5(seed:b:i) mod n, so any engine can repeat it.
    """
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(unit, F.col(value).cast("double").alias("v")))).alias("_a"))
    g = g.withColumn("_v", F.col("_a.v")).withColumn("_n", F.size("_v")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    picks = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda i: F.element_at("_v", (hash_index([F.lit(seed), F.col("b"), i], F.col("_n")) + 1).cast("int")))
    total = F.aggregate(picks, F.lit(0.0), lambda acc, v: acc + v)
    return g.select(*keys, F.col("b").cast("bigint").alias("b"), (total / F.col("_n")).alias("mean"))


def bootstrap_interval(df: DataFrame, keys: list[str], unit: str, value: str, rounds: int, seed: int) -> DataFrame:
    """2.5 / 97.5 percentile interval of the resampled mean."""
    m = bootstrap_means(df, keys, unit, value, rounds, seed)
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return m.groupBy(*keys).agg(q.alias("_q")).select(
        *keys, F.element_at("_q", 1).alias("ci_low"), F.element_at("_q", 2).alias("ci_high"))


def digit_words(n: int) -> list[list[int]]:
    """Factorial digits of n units (digit k counts below k) grouped into words of products below 2^32, two at least."""
    words, product = [[]], 1
    for k in range(n, 1, -1):
        half = len(words) == 1 and product * product > math.factorial(n)
        if words[-1] and (product * k >= 1 << 32 or half):
            words.append([])
            product = 1
        words[-1].append(k)
        product *= k
    return words


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed_permutations(start: int, count: int, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Permutations number ``start`` .. of n units under a keyed bijection of the n! numbers.

    A number is a row of words in mixed radix; each round adds to a word a keyed hash of the others,
    modulo the word's size. That can be undone, so different numbers below n! give different
    permutations: a sample without replacement, of which any range can be made in any task.
    """
    words = digit_words(n)
    sizes = [math.prod(w) for w in words]
    left = np.arange(start, start + count, dtype=np.uint64)
    parts = []
    for size in sizes:
        parts.append(left % np.uint64(size))
        left = left // np.uint64(size)
    with np.errstate(over="ignore"):
        for r in range(rounds):
            for w, size in enumerate(sizes):
                h = np.full(count, (seed * 1_000_003 + r * 1_009 + w) % (1 << 64), np.uint64)
                for v, other in enumerate(parts):
                    if v != w:
                        h = _mixed(h + (other + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                parts[w] = (parts[w] + _mixed(h) % np.uint64(size)) % np.uint64(size)
    perm = np.zeros((count, n), np.int64)
    at = 0
    for part, word in zip(parts, words):
        for k in word:
            perm[:, at] = (part % np.uint64(k)).astype(np.int64)
            part = part // np.uint64(k)
            at += 1
    for j in range(n - 2, -1, -1):  # factorial digits to a permutation
        perm[:, j + 1 :] += perm[:, j + 1 :] >= perm[:, j : j + 1]
    return perm


def share_interval(hits: int, draws: int, miss: float) -> tuple[float, float]:
    """Bounds that hold a share with probability 1 - miss, from a sample with or without replacement (relative entropy bound)."""
    seen, limit = hits / draws, math.log(2 / miss) / draws

    def entropy(q: float) -> float:
        a = seen * math.log(seen / q) if seen else 0.0
        return a + ((1 - seen) * math.log((1 - seen) / (1 - q)) if seen < 1 else 0.0)

    def edge(inside: float, outside: float) -> float:
        for _ in range(60):
            middle = (inside + outside) / 2
            inside, outside = (middle, outside) if 0 < middle < 1 and entropy(middle) <= limit else (inside, middle)
        return outside

    return (edge(seen, 0.0) if seen else 0.0), (edge(seen, 1.0) if seen < 1 else 1.0)
