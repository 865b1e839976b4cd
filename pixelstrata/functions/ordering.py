"""Distributed ordering helpers: no group is ever pulled into one sort.

A key may hold a large share of all rows, so row numbers, running sums, lags and
exact quantiles are computed in two levels: inside bounded sub-ranges of the
ordering column, then across the (few) sub-range totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelstrata.sources.storage import cut_lineage


def _cols(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def ordinal_within(df: DataFrame, keys, order: Sequence[str], bucket: Column, name: str = "frame") -> DataFrame:
    """1-based row number of each row within ``keys`` ordered by ``order``.

    ``bucket`` must be non-decreasing in the ordering; it splits a hot key into
    sub-ranges that are sorted independently, and their counts are prefix-summed.
    """
    ks = _cols(keys)
    b = df.withColumn("_b", bucket)
    sizes = b.groupBy(*ks, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*ks).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(*ks, "_b", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(W.partitionBy(*ks, "_b").orderBy(*order))
    return (
        b.withColumn("_rn", local)
        .join(starts, [*ks, "_b"])
        .withColumn(name, (F.col("_start") + F.col("_rn")).cast("bigint"))
        .drop("_b", "_rn", "_start")
    )


def range_ordinals(df: DataFrame, keys, order: Sequence, name: str = "frame") -> DataFrame:
    """1-based row number of each row within ``keys`` in the order given, whatever the values are.

    Spark samples the rows and deals them into sorted ranges of (keys, order), so a hot key and a
    run of equal leading values fill as many tasks as they need. Inside a range the place follows
    from the row's position; ranges of a key are added up. Equal rows come in any order.
    """
    ks = _cols(keys)
    by = [*ks, *order]
    placed = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))  # numbers rise inside a range
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(*ks, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*ks or [F.lit(1)]).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(ks)], "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    same = part == F.col("_part")
    for i, k in enumerate(ks):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(sizes, same).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("bigint").alias(name))


def with_halo(df: DataFrame, index: str, chunk: int, before: int = 0, after: int = 0) -> DataFrame:
    """Split a long ordered series into chunks that carry their neighbours.

    Adds ``_chunk`` and ``_core``. Windows partitioned by (keys, _chunk) then see
    ``before`` preceding and ``after`` following rows; keep ``_core`` rows only.
    Requires a dense integer ``index`` and ``before, after <= chunk``.
    """
    i = F.col(index)
    home = F.floor(i / chunk)
    offset = i - home * chunk
    homes = F.array_compact(
        F.array(
            home,
            F.when(offset >= chunk - before, home + 1) if before else F.lit(None).cast("bigint"),
            F.when(offset < after, home - 1) if after else F.lit(None).cast("bigint"),
        )
    )
    return df.withColumn("_chunk", F.explode(homes)).withColumn("_core", F.col("_chunk") == home)


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float], accuracy: int = 10_000, few: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles per key without one task per key.

    A sketch of bounded size brackets each wanted rank by two values, whatever the values'
    distribution. Rows below the bracket are only counted; the few inside it (about
    ``8 / accuracy`` of a key's rows, or all of a key of at most ``4 * accuracy``) are
    counted by value and ordered. Two passes, and no row is shuffled before it is counted,
    if the keys are ``few``: their brackets are then sent to the rows.
    """
    ks = _cols(keys)
    if not ks:
        df, ks = df.withColumn("_all", F.lit(1)), ["_all"]
    names, e = list(probs), 4.0 / accuracy
    d = df.where(F.col(value).isNotNull()).select(*ks, F.col(value).cast("double").alias("_v"))
    marks = [x for n in names for x in (max(0.0, probs[n] - e), min(1.0, probs[n] + e))]
    sketch = d.groupBy(*ks).agg(F.percentile_approx("_v", F.array(*map(F.lit, marks)), accuracy).alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    small = F.col("_n") <= 4 * accuracy
    edge = lambda k, at, end: F.when(small | F.lit(at == end), F.col("_lo" if end == 0 else "_hi")).otherwise(F.get("_m", F.lit(k)))
    sides = [(edge(2 * i, marks[2 * i], 0), edge(2 * i + 1, marks[2 * i + 1], 1)) for i in range(len(names))]
    sketch = sketch.select(*ks, "_n", *[c.alias(f"_{s}{i}") for i, pair in enumerate(sides) for s, c in zip("lh", pair)])
    # per wanted quantile: the value inside the bracket, null below it, no entry above it
    v = F.col("_v")
    entry = lambda i: F.when(v <= F.col(f"_h{i}"), F.struct(F.lit(i).alias("q"), F.when(v >= F.col(f"_l{i}"), v).alias("v")))
    rows = d.join(F.broadcast(sketch) if few else sketch, ks).select(*ks, "_n", F.explode(F.array_compact(F.array(*[entry(i) for i in range(len(names))]))).alias("_e"))
    counts = rows.groupBy(*ks, F.col("_e.q").alias("_q"), F.col("_e.v").alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    run = F.sum("_c").over(W.partitionBy(*ks, "_q").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    share = F.element_at(F.array(*[F.lit(float(probs[n])) for n in names]), F.col("_q") + 1)
    placed = counts.withColumn("_stop", run).withColumn("_from", F.col("_stop") - F.col("_c")).withColumn("_pos", share * (F.col("_n") - 1))
    k0, k1 = F.floor("_pos"), F.ceil("_pos")
    has = lambda k: (k >= F.col("_from")) & (k < F.col("_stop"))
    weight = F.when(has(k0), 1 - (F.col("_pos") - k0)).otherwise(0.0) + F.when(has(k1) & (k1 > k0), 1 - (k1 - F.col("_pos"))).otherwise(0.0)
    placed = placed.withColumn("_w", weight).where("_w > 0")
    out = placed.groupBy(*ks).agg(*[F.sum(F.when(F.col("_q") == i, F.col("_v") * F.col("_w"))).alias(n) for i, n in enumerate(names)])
    return out.drop("_all") if ks == ["_all"] else out


def add_bounded_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """Adds exact interpolated quantiles of the row's group as columns.

    For groups with a known size bound (the pixels of one map, one condition
    table): one shuffle and a spillable sort, no hash of all values, no join back.
    """
    ks = _cols(keys)
    part = W.partitionBy(*ks) if ks else W.partitionBy(F.lit(1))
    v = F.col(value).cast("double")
    d = df.withColumn("_k", F.row_number().over(part.orderBy(v.asc_nulls_last())) - 1).withColumn("_n", F.count(v).over(part))
    weight = lambda p: F.greatest(F.lit(0.0), 1 - F.abs(F.lit(float(p)) * (F.col("_n") - 1) - F.col("_k")))
    return d.select(*df.columns, *[F.sum(F.when(weight(p) > 0, v * weight(p))).over(part).alias(n) for n, p in probs.items()])


def bounded_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key with the quantiles of :func:`add_bounded_quantiles`."""
    ks = _cols(keys)
    d = add_bounded_quantiles(df.select(*ks, value), ks, value, probs)
    return d.groupBy(*ks).agg(*[F.max(n).alias(n) for n in probs])


def average_rank(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    """Rank with ties averaged, for bounded groups (conditions, strategies)."""
    ks = _cols(keys)
    by = W.partitionBy(*ks) if ks else W.partitionBy(F.lit(1))
    ties = W.partitionBy(*ks, value) if ks else W.partitionBy(value)
    rank = F.rank().over(by.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), rank.cast("double")))


def first_n(df: DataFrame, keys, order: Sequence, n: int) -> DataFrame:
    """First n rows per key (Spark prunes with a group limit before the shuffle)."""
    w = W.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
