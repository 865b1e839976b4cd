"""Frames as tile arrays: moments, residuals, halos and stencils without pixel rows.

Tile rows are (keys, frame, top, left, h, w, value array), row-major. Statistics over frames
travel as mergeable moments (count, mean, sum of squared deviations) of whole tiles, which
every task forms before anything is shuffled. Stencils work on a tile and a margin that its
neighbours send (halo exchange), so what is shuffled is arrays, at most nine to a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelstrata.sources.storage import cut_lineage

PLACE = ["top", "left", "h", "w"]
FAN_IN = 16  # partial maps merged by one call
HELD_BYTES = 64 << 20  # partial maps that a task holds before it hands them on


def flat(column: pa.Array) -> np.ndarray:
    """All values of a list column, row after row, as doubles."""
    return np.asarray(column.flatten()).astype(np.float64, copy=False)


def lists(values: np.ndarray, like: pa.Array) -> pa.Array:
    """Values cut into lists of the same lengths as another list column."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(like.value_lengths().fill_null(0)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float64()))


def typed(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)


@dataclass
class Shape:
    """Largest extent of the frames, height of a tile, and frame number; ``whole``: every frame is one tile."""

    height: int
    width: int
    band: int
    last: int
    whole: bool = False


def frame_shape(tiles: DataFrame, index: str | None = "frame") -> Shape:
    """One row of numbers over the place columns; the pixels are not read."""
    last = F.max(index) if index else F.lit(0)
    r = tiles.agg(F.max(F.col("top") + F.col("h")).alias("a"), F.max(F.col("left") + F.col("w")).alias("b"), F.max("h").alias("c"), last.alias("d"), F.min(F.col("h") * F.col("w")).alias("e")).first()
    a, b, c, d, e = (int(x or 0) for x in r)
    return Shape(a, b, c, d, e == a * b)


def merged(n1, mean1, m1, n2, mean2, m2):
    """Moments of two groups of frames together."""
    n = n1 + n2
    d = mean2 - mean1
    return n, mean1 + d * (n2 / n), m1 + m2 + d * d * (n1 * n2 / n)


def _merge_rows(rows: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    total = None
    for n, mean, m2 in zip(rows["n"], rows["mean"], rows["m2"]):
        part = (int(n), np.asarray(mean), np.asarray(m2))
        total = part if total is None else merged(*total, *part)
    return total


def tile_moments(tiles: DataFrame, keys: list[str], value: str = "dn") -> DataFrame:
    """(keys, top, left, h, w, n, mean, m2): moments over all rows of each key and place.

    Tasks form partial moments, which are merged ``FAN_IN`` at a time, by rising ranges of
    partitions: one key's frames may fill any number of tasks.
    """
    by = [*keys, *PLACE]
    schema = typed(tiles, by) + ", n bigint, mean array<double>, m2 array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def out(types: list[pa.DataType]) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
            values = [pa.array([v[i] for v in held.values()], pa.int64() if not i else pa.list_(pa.float64())) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, *values], names=[*by, "n", "mean", "m2"])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(c).type for c in by]
            values, ends = flat(batch.column(value)), np.cumsum(np.asarray(batch.column(value).value_lengths()))
            for row, (key, b) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in by)), ends)):
                x = values[(ends[row - 1] if row else 0) : b]
                if key not in held:
                    held[key] = [1, x.copy(), np.zeros(len(x))]
                    size += 16 * len(x)
                    continue
                part = held[key]
                part[0] += 1
                d = x - part[1]
                part[1] += d / part[0]
                part[2] += d * (x - part[1])
            if size > HELD_BYTES:
                yield out(types)
                held.clear()
                size = 0
        if held:
            yield out(types)

    parts = tiles.select(*by, value).mapInArrow(partial, schema).withColumn("_part", F.spark_partition_id())
    return _merge_tree(parts, by, typed(tiles, by), tiles.rdd.getNumPartitions())


def _merge_tree(parts: DataFrame, by: list[str], head: str, tasks: int) -> DataFrame:
    """Moments merged over the tasks that made them (``_part``), ``FAN_IN`` neighbours at a time."""
    schema = head + ", _part int, n bigint, mean array<double>, m2 array<double>"

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n, mean, m2 = _merge_rows(rows)
        head = {c: [rows[c].iloc[0]] for c in [*by, "_part"]}
        return pd.DataFrame({**head, "n": [n], "mean": [mean], "m2": [m2]})

    while True:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("_part", F.floor(F.col("_part") / FAN_IN).cast("int") if tasks > 1 else F.lit(0))
        parts = parts.groupBy(*by, "_part").applyInPandas(merge, schema)
        if tasks == 1:
            return parts.drop("_part")


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of each key and place from a bounded number of rows of moments."""
    by = [*keys, *PLACE]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n, mean, m2 = _merge_rows(rows)
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in by}, "n": [n], "mean": [mean], "m2": [m2]})

    return parts.select(*by, "n", "mean", "m2").groupBy(*by).applyInPandas(merge, typed(parts, by) + ", n bigint, mean array<double>, m2 array<double>")


def map_arrays(df: DataFrame, keep: list[str], inputs: list[str], name: str, fn: Callable[..., np.ndarray]) -> DataFrame:
    """Adds an array column computed from the flattened values of other array columns of equal lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(*(flat(batch.column(c)) for c in inputs))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists(out, batch.column(inputs[0]))], names=[*keep, name])

    return df.select(*keep, *(c for c in inputs if c not in keep)).mapInArrow(run, typed(df, keep) + f", `{name}` array<double>")


def tile_residual(tiles: DataFrame, demean: bool = True, keys: tuple[str, ...] = ("folder",), value: str = "dn", shape: Shape | None = None) -> DataFrame:
    """(keys, frame, place, r): value minus the temporal mean map and, optionally, minus the frame's mean of that.

    A frame's mean residual is its own mean minus the map's, so it comes from one number of
    each tile; where a ``shape`` says that a tile is a whole frame, the tile itself has it.
    """
    def level_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = (a - b).reshape(-1, shape.height * shape.width)
        return (r - r.mean(1, keepdims=True)).ravel()

    ks = list(keys)
    maps = tile_moments(tiles, ks, value).select(*ks, "top", "left", F.col("mean").alias("_mean"))
    joined = tiles.join(maps, [*ks, "top", "left"])
    keep = [*ks, "frame", *PLACE]
    alone = demean and shape is not None and shape.whole
    r = map_arrays(joined, keep, [value, "_mean"], "r", level_rows if alone else np.subtract)
    if alone or not demean:
        return r
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    frames = tiles.groupBy(*ks, "frame").agg(F.sum(total(F.col(value).cast("array<double>"))).alias("_s"), F.sum(F.size(value)).alias("_n"))
    level = maps.groupBy(*ks).agg(F.sum(total(F.col("_mean"))).alias("_m"), F.sum(F.size("_mean")).alias("_k"))
    frames = frames.join(level, ks).select(*ks, "frame", (F.col("_s") / F.col("_n") - F.col("_m") / F.col("_k")).alias("_shift"))
    shifted = r.join(frames, [*ks, "frame"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("r")
            shift = np.repeat(np.asarray(batch.column("_shift")), np.asarray(column.value_lengths()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists(flat(column) - shift, column)], names=[*keep, "r"])

    return shifted.select(*keep, "r", "_shift").mapInArrow(run, typed(r, [*keep, "r"]))


def over_pixels(parts: list[tuple[int, float, float]]) -> tuple[int, float, float]:
    """Count, mean and sum of squared deviations of groups of pixels together."""
    total = (0, 0.0, 0.0)
    for part in parts:
        if part[0]:
            total = merged(*total, *part) if total[0] else part
    return total


def _of(values: np.ndarray) -> tuple[int, float, float]:
    mean = float(values.mean()) if values.size else 0.0
    return values.size, mean, float(((values - mean) ** 2).sum())


def crop_summaries(tiles: DataFrame, crops: dict[int, tuple[int, int, int]], counts: list[int | None]) -> DataFrame:
    """Noise summary of every crop {name: (top, left, size)} and leading frame count (None = all) from one scan.

    Frames fall into ranges between the counts. A scan gives moments of each tile and range and,
    of each tile row, one sum for each crop; ranges are then merged from the first on, so the
    frames of a longer count are never visited again, and a crop is a slice of a merged tile.
    """
    ends = sorted(c for c in counts if c)
    rng = sum(((F.col("frame") > c).cast("int") for c in ends), F.lit(0))
    by = ["folder", "_range", *PLACE]
    given = tiles.withColumn("_range", rng.cast("int"))
    boxes = list(crops.items())
    head = typed(given, by)

    def inside(top, left, h, w, box):
        t, l, size = box
        a, b, c, d = max(top, t), min(top + h, t + size), max(left, l), min(left + w, l + size)
        return (slice(a - top, b - top), slice(c - left, d - left)) if a < b and c < d else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        held: dict[tuple, list] = {}

        def out(keys: list[tuple], moments: list, frames: list, sums: list) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)]
            columns += [pa.array([m[0] for m in moments], pa.int64()), *(pa.array([m[i] for m in moments], pa.list_(pa.float64())) for i in (1, 2))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(frames, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=[*by, "n", "mean", "m2", "frame", "sums"])

        for batch in batches:
            kinds = [batch.column(c).type for c in by]
            values, past = flat(batch.column("dn")), np.cumsum(np.asarray(batch.column("dn").value_lengths()))
            keys, frames, sums = list(zip(*(batch.column(c).to_pylist() for c in by))), batch.column("frame").to_pylist(), []
            for row, key in enumerate(keys):
                x = values[(past[row - 1] if row else 0) : past[row]]
                part = held.setdefault(key, [0, np.zeros(len(x)), np.zeros(len(x))])
                part[0] += 1
                d = x - part[1]
                part[1] += d / part[0]
                part[2] += d * (x - part[1])
                tile = x.reshape(key[4], key[5])
                cuts = [inside(*key[2:], box) for _, box in boxes]
                sums.append([v for cut in cuts for v in ((tile[cut].sum(), tile[cut].size) if cut else (0.0, 0.0))])
            yield out(keys, [[0, None, None]] * len(keys), frames, sums)
            if sum(16 * len(v[1]) for v in held.values()) > HELD_BYTES:
                yield out(list(held), list(held.values()), [None] * len(held), [None] * len(held))
                held.clear()
        if held:
            yield out(list(held), list(held.values()), [None] * len(held), [None] * len(held))

    scanned = cut_lineage(given.select(*by, "frame", "dn").mapInArrow(scan, head + ", n bigint, mean array<double>, m2 array<double>, frame bigint, sums array<double>").withColumn("_part", F.spark_partition_id()))
    maps, tasks = scanned.where("frame is null").drop("frame", "sums"), scanned.rdd.getNumPartitions()
    maps = _merge_tree(maps, by, head, tasks)

    def prefixes(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_range")
        top, left, h, w = (int(rows[c].iloc[0]) for c in PLACE)
        total, out = None, []
        parts = {int(r): (int(n), np.asarray(m), np.asarray(q)) for r, n, m, q in zip(rows["_range"], rows["n"], rows["mean"], rows["m2"])}
        for k in range(len(ends) + 1):
            if k in parts:
                total = parts[k] if total is None else merged(*total, *parts[k])
            if total is None or not (k < len(ends) or None in counts):
                continue
            n, mean, m2 = (total[0], total[1].reshape(h, w), total[2].reshape(h, w))
            var = m2 / (n - 1) if n > 1 else np.full_like(m2, np.nan)
            for name, box in boxes:
                if cut := inside(top, left, h, w, box):
                    pixels, level, spread = _of(mean[cut])
                    out.append((name, ends[k] if k < len(ends) else 0, n, pixels, level, spread, float(np.sqrt(var[cut]).sum()), float(var[cut].sum())))
        names = ["crop", "frames", "frame_count", "pixels", "level", "spread", "std_sum", "var_sum"]
        return pd.DataFrame(out, columns=names).assign(folder=rows["folder"].iloc[0])[["folder", *names]]

    cell = ["folder", "crop", "frames"]
    kind = dict(tiles.dtypes)["folder"]
    parts = maps.groupBy("folder", *PLACE).applyInPandas(prefixes, f"folder {kind}, crop bigint, frames bigint, frame_count bigint, pixels bigint, level double, spread double, std_sum double, var_sum double")
    pixels, number = F.sum("pixels"), lambda c: F.when(F.isnan(c), None).otherwise(c)
    whole = parts.groupBy(*cell).agg(
        F.max("frame_count").alias("frame_count"), pixels.alias("_n"), (F.sum(F.col("level") * F.col("pixels")) / pixels).alias("mean_signal"),
        number(F.sum("std_sum") / pixels).alias("temporal_std_mean"), number(F.sum("var_sum") / pixels).alias("temporal_var_mean"))
    fixed = parts.join(whole.select(*cell, "_n", "mean_signal"), cell).groupBy(*cell, "_n").agg(
        F.sum(F.col("spread") + F.col("pixels") * F.pow(F.col("level") - F.col("mean_signal"), 2)).alias("_s"))
    fixed = fixed.select(*cell, F.when(F.col("_n") > 1, F.sqrt(F.col("_s") / (F.col("_n") - 1))).alias("fixed_std"))
    at = F.array(*[F.struct(F.lit(name).cast("bigint").alias("crop"), F.get("_s", F.lit(2 * i)).alias("s"), F.get("_s", F.lit(2 * i + 1)).alias("n")) for i, (name, _) in enumerate(boxes)])
    frames = scanned.where("frame is not null").select("folder", "frame", F.col("sums").alias("_s")).select("folder", "frame", F.explode(at).alias("_c"))
    frames = frames.groupBy("folder", "frame", "_c.crop").agg((F.sum("_c.s") / F.nullif(F.sum("_c.n"), F.lit(0.0))).alias("m"))
    some = {c or 0: (F.col("frame") <= c if c else F.lit(True)) for c in counts}
    spread = frames.groupBy("folder", "crop").agg(*[F.stddev_samp(F.when(t, F.col("m"))).alias(f"_{c}") for c, t in some.items()])
    spread = spread.select("folder", "crop", F.explode(F.array(*[F.struct(F.lit(c).cast("bigint").alias("frames"), F.col(f"_{c}").alias("frame_mean_std")) for c in some])).alias("_f")).select("folder", "crop", "_f.*")
    return whole.drop("_n").join(fixed, cell).join(spread, cell)


# -- halo exchange ------------------------------------------------------------------------

def _index(start: int, stop: int, size: int, border: str) -> np.ndarray:
    """Rows (or columns) of a frame that stand at places start to stop - 1, which may lie outside."""
    at = np.arange(start, stop)
    if border == "reflect":  # the edge sample is repeated, then the order turns
        at = at % (2 * size)
        return np.where(at >= size, 2 * size - 1 - at, at)
    return np.clip(at, 0, size - 1)


def stencil(tiles: DataFrame, keys: list[str], value: str, margin: int, shape: Shape, fn: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str], border: str = "edge") -> DataFrame:
    """(keys, place, names): ``fn`` on every tile widened by ``margin`` on each side.

    ``fn`` takes the widened array and returns arrays of the tile's own size. Outside the frame
    stands what ``border`` says: the edge sample ("edge"), its mirror image ("reflect") or NaN;
    a NaN that ``fn`` returns is null in the result.
    Every tile sends each tile that needs it the part it needs; tiles form a grid whose step is
    the height and width of the first tile, and may be smaller at the lower and right border.
    """
    by = [*keys, "top", "left"]
    kinds = dict(tiles.dtypes)
    height, width = shape.height, shape.width
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", top int, left int, h int, w int, " + ", ".join(f"`{n}` array<double>" for n in names)

    def widened(known: np.ndarray, y0: int, x0: int, top: int, left: int, h: int, w: int) -> np.ndarray:
        """A tile and its margin from the part of the frame that begins at (y0, x0)."""
        ys, xs = (_index(a - margin, a + n + margin, full, border) for a, n, full in ((top, h, height), (left, w, width)))
        wide = known[np.ix_(ys - y0, xs - x0)]
        if border == "nan":
            oy, ox = (np.arange(a - margin, a + n + margin) for a, n in ((top, h), (left, w)))
            wide = np.where(((oy < 0) | (oy >= height))[:, None] | ((ox < 0) | (ox >= width))[None, :], np.nan, wide)
        return wide

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(widened(f, 0, 0, 0, 0, height, width)) for f in flat(batch.column(value)).reshape(-1, height, width)]
            out = []
            for n in names:
                parts = [np.asarray(m[n], np.float64).ravel() for m in made]
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64(), from_pandas=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *(batch.column(c).cast(pa.int32()) for c in PLACE), *out], names=[*keys, *PLACE, *names])

    if shape.whole:  # a frame of one tile has no neighbours and stays in its task
        return tiles.select(*keys, *PLACE, value).mapInArrow(alone, schema)
    step = tiles.where("top = 0 and left = 0").select("h", "w").first()
    dy, dx = (int(step["h"]), int(step["w"])) if step else (1, 1)

    def wanted(start: int, size: int, full: int) -> np.ndarray:
        at = np.arange(start - margin, start + size + margin)
        inside = at[(at >= 0) & (at < full)] if border == "nan" else _index(start - margin, start + size + margin, full, border)
        return np.unique(inside)

    def overlap(a: int, n: int, full: int, pace: int) -> list[tuple[int, int, int]]:
        """(start of a tile row, first and past of what it needs of [a, a + n))."""
        out = []
        for start in range(0, full, pace):
            if border != "reflect" and (start - margin >= a + n or start + pace + margin <= a):
                continue
            need = wanted(start, min(pace, full - start), full)
            need = need[(need >= a) & (need < a + n)]
            if len(need):
                out.append((start, int(need[0]), int(need[-1]) + 1))
        return out

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list] = {}
        for batch in batches:
            row, to, parts = [], [], []
            values, ends = flat(batch.column(value)), np.cumsum(np.asarray(batch.column(value).value_lengths()))
            for r, (top, left, h, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in PLACE))):
                tile = values[ends[r] - h * w : ends[r]].reshape(h, w)
                for axis in ((top, h, height, dy), (left, w, width, dx)):
                    if axis not in known:
                        known[axis] = overlap(*axis)
                for ty, y0, y1 in known[(top, h, height, dy)]:
                    for tx, x0, x1 in known[(left, w, width, dx)]:
                        row.append(r)
                        to.append((ty, tx, y0, x0, y1 - y0, x1 - x0))
                        parts.append(tile[y0 - top : y1 - top, x0 - left : x1 - left].ravel())
            columns = [batch.column(c).take(pa.array(row, pa.int64())) for c in keys]
            places = [pa.array([t[i] for t in to], pa.int32()) for i in range(6)]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            part = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([*columns, *places, part], names=[*by, "_y", "_x", "_h", "_w", "_v"])

    sent = tiles.select(*keys, *PLACE, value).mapInArrow(send, typed(tiles, keys) + ", top int, left int, _y int, _x int, _h int, _w int, _v array<double>")

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        top, left = int(rows["top"].iloc[0]), int(rows["left"].iloc[0])
        h, w = min(dy, height - top), min(dx, width - left)
        y0, x0 = int(rows["_y"].min()), int(rows["_x"].min())
        y1, x1 = int((rows["_y"] + rows["_h"]).max()), int((rows["_x"] + rows["_w"]).max())
        known = np.full((y1 - y0, x1 - x0), np.nan)
        for y, x, n, m, v in zip(rows["_y"], rows["_x"], rows["_h"], rows["_w"], rows["_v"]):
            known[y - y0 : y - y0 + n, x - x0 : x - x0 + m] = np.asarray(v).reshape(n, m)
        made = fn(widened(known, y0, x0, top, left, h, w))
        head = {**{c: [rows[c].iloc[0]] for c in keys}, "top": [top], "left": [left], "h": [h], "w": [w]}
        return pd.DataFrame({**head, **{n: [np.ascontiguousarray(made[n]).ravel()] for n in names}})

    return sent.groupBy(*by).applyInPandas(assemble, schema)


def central(wide: np.ndarray) -> dict[str, np.ndarray]:
    """gy, gx, grad from a margin of one with NaN outside: central differences, one-sided at the border."""
    def axis(a: np.ndarray) -> np.ndarray:
        before, here, after = a[:-2, 1:-1], a[1:-1, 1:-1], a[2:, 1:-1]
        both = (after - before) / 2
        return np.where(np.isnan(before), after - here, np.where(np.isnan(after), here - before, both))

    gy, gx = axis(wide), axis(wide.T).T
    return {"gy": gy, "gx": gx, "grad": np.sqrt(gx * gx + gy * gy)}


def box(radius: int) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    """local_mean and local_std over a square of 2 * radius + 1; NaN where it leaves the frame (margin ``radius``, border "nan")."""
    def run(wide: np.ndarray) -> dict[str, np.ndarray]:
        view = np.lib.stride_tricks.sliding_window_view(wide, (2 * radius + 1, 2 * radius + 1))
        mean = view.mean((2, 3))
        return {"local_mean": mean, "local_std": np.sqrt(np.maximum((view * view).mean((2, 3)) - mean * mean, 0.0))}

    return run


def blur(kernel: list[tuple[int, float]]) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    """low and hp (value minus low) of a separable kernel (margin: its largest offset, border "reflect")."""
    margin = max(abs(k) for k, _ in kernel)

    def run(wide: np.ndarray) -> dict[str, np.ndarray]:
        h, w = wide.shape[0] - 2 * margin, wide.shape[1] - 2 * margin
        rows = sum(c * wide[margin + k : margin + k + h] for k, c in kernel)
        low = sum(c * rows[:, margin + k : margin + k + w] for k, c in kernel)
        return {"low": low, "hp": wide[margin : margin + h, margin : margin + w] - low}

    return run


def lag_products(tiles: DataFrame, keys: list[str], value: str, reach: int, shape: Shape) -> DataFrame:
    """(keys, dy, dx, n, total): sums of products of pixels dy in [0, reach] and dx in [-reach, reach] apart, tile by tile."""
    frames = [*keys, "frame"]
    names = ["dy", "dx", "n", "total"]

    def products(wide: np.ndarray) -> dict[str, np.ndarray]:
        h, w = wide.shape[0] - 2 * reach, wide.shape[1] - 2 * reach
        here, out = wide[reach : reach + h, reach : reach + w], []
        for dy in range(reach + 1):
            for dx in range(-reach, reach + 1):
                p = here * wide[reach + dy : reach + dy + h, reach + dx : reach + dx + w]
                out.append((dy, dx, np.count_nonzero(~np.isnan(p)), np.nansum(p)))
        return {c: np.array([o[i] for o in out], np.float64) for i, c in enumerate(names)}

    made = stencil(tiles, frames, value, reach, shape, products, names, "nan")
    e = made.select(*keys, F.explode(F.arrays_zip(*names)).alias("_p"))
    return e.groupBy(*keys, F.col("_p.dy").cast("bigint").alias("dy"), F.col("_p.dx").cast("bigint").alias("dx")).agg(
        F.sum("_p.n").cast("bigint").alias("n"), F.sum("_p.total").alias("total"))


def neighbour_sums(tiles: DataFrame, keys: list[str], value: str, offsets: list[tuple[int, int]], shape: Shape) -> DataFrame:
    """(keys, dy, dx, ab, aa, bb): sums over all pairs of pixels (dy, dx) apart inside a frame.

    A tile that is a whole frame needs no margin and stays in its task.
    """
    reach = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    names = ["dy", "dx", "ab", "aa", "bb"]

    def sums(wide: np.ndarray) -> dict[str, np.ndarray]:
        h, w = wide.shape[0] - 2 * reach, wide.shape[1] - 2 * reach
        here, out = wide[reach : reach + h, reach : reach + w], []
        for dy, dx in offsets:
            there = wide[reach + dy : reach + dy + h, reach + dx : reach + dx + w]
            both = ~np.isnan(there) & ~np.isnan(here)
            a, b = here[both], there[both]
            out.append((dy, dx, a @ b, a @ a, b @ b))
        return {c: np.array([o[i] for o in out], np.float64) for i, c in enumerate(names)}

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            wide = (np.pad(np.asarray(v, np.float64).reshape(h, w), reach, constant_values=np.nan) for v, h, w in zip(rows[value], rows["h"], rows["w"]))
            made = [sums(f) for f in wide]
            yield rows[keys].assign(**{n: [m[n] for m in made] for n in names})

    if shape.whole:
        made = tiles.select(*keys, "h", "w", value).mapInPandas(alone, typed(tiles, keys) + ", " + ", ".join(f"{n} array<double>" for n in names))
    else:
        made = stencil(tiles, [*keys, "frame"], value, reach, shape, sums, names, "nan")
    e = made.select(*keys, F.explode(F.arrays_zip(*names)).alias("_p"))
    return e.groupBy(*keys, F.col("_p.dy").cast("int").alias("dy"), F.col("_p.dx").cast("int").alias("dx")).agg(
        *[F.sum(f"_p.{c}").alias(c) for c in names[2:]])


def profile_energy(tiles: DataFrame, keys: list[str], value: str, shape: Shape) -> DataFrame:
    """(keys, row_energy, column_energy): root mean square of the row and column means of all frames.

    A tile gives one sum for each of its rows and columns; only these are shuffled.
    """
    names = [*keys, "frame", "top", "left"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            tile = [np.asarray(v, np.float64).reshape(h, w) for v, h, w in zip(rows[value], rows["h"], rows["w"])]
            yield rows[names].assign(rows=[t.sum(1) for t in tile], columns=[t.sum(0) for t in tile])

    sums = tiles.select(*names, "h", "w", value).mapInPandas(run, typed(tiles, names) + ", rows array<double>, columns array<double>")
    line = lambda c, start: F.transform(c, lambda v, i: F.struct((F.col(start) + i).alias("at"), v.alias("v")))
    e = sums.select(*keys, "frame", F.explode(F.array(
        F.struct(F.lit(True).alias("row"), line("rows", "top").alias("p")), F.struct(F.lit(False).alias("row"), line("columns", "left").alias("p")))).alias("_s"))
    e = e.select(*keys, "frame", "_s.row", F.explode("_s.p").alias("_p")).groupBy(*keys, "frame", "row", "_p.at").agg(F.sum("_p.v").alias("v"))
    mean = F.col("v") / F.when(F.col("row"), F.lit(shape.width)).otherwise(F.lit(shape.height))
    energy = lambda c: F.sqrt(F.avg(F.when(c, mean * mean)))
    return e.groupBy(*keys).agg(energy(F.col("row")).alias("row_energy"), energy(~F.col("row")).alias("column_energy"))


def map_pair_sums(maps: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, pair sums) of two array columns of each row; ``corr_of_sums`` over them is a correlation of whole maps."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sums = [pair_sums(np.asarray(x, np.float64), np.asarray(y, np.float64))[0] for x, y in zip(rows[a], rows[b])]
            yield pd.concat([rows[keys].reset_index(drop=True), pd.DataFrame(sums, columns=["n", "sa", "sb", "saa", "sbb", "sab"])], axis=1)

    return maps.select(*keys, a, b).mapInPandas(run, typed(maps, keys) + ", n bigint, sa double, sb double, saa double, sbb double, sab double")


# -- lags in time -------------------------------------------------------------------------

def lagged_tiles(tiles: DataFrame, keys: list[str], value: str, lags: list[int], fn: Callable[..., list[dict[str, float]]], schema: str, label: str | None = None, chunk: int = 64) -> DataFrame:
    """(keys, frame, lag, ...): ``fn(a, b)`` on the tiles of frames f and f + lag at one place, a row for each dictionary.

    Frames travel in chunks that carry the frames they reach into, so a tile is copied
    1 + lag / ``chunk`` times and no pixel is joined. With ``label``, an array that belongs to
    the place, ``fn`` takes it third.
    """
    reach = max(lags)
    home = F.floor(F.col("frame") / chunk)
    ahead = F.sequence(F.lit(0), F.lit(-(-reach // chunk)))
    homes = F.filter(F.transform(ahead, lambda k: home - k), lambda c: (F.col("frame") < (c + 1) * chunk + reach))
    more = [label] if label else []
    rows = tiles.select(*keys, "frame", "top", "left", value, *more).withColumn("_chunk", F.explode(homes))
    names = [p.split()[0] for p in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        here = int(pdf["_chunk"].iloc[0])
        at = {int(f): np.asarray(v, np.float64) for f, v in zip(pdf["frame"], pdf[value])}
        extra = [np.asarray(pdf[label].iloc[0])] if label else []
        out = [{"frame": f, "lag": lag, **numbers} for f, a in at.items() if f // chunk == here for lag in lags if f + lag in at for numbers in fn(a, at[f + lag], *extra)]
        return pd.DataFrame(out, columns=["frame", "lag", *names]).assign(**{c: pdf[c].iloc[0] for c in keys})[[*keys, "frame", "lag", *names]]

    return rows.groupBy(*keys, "top", "left", "_chunk").applyInPandas(run, typed(tiles, keys) + f", frame bigint, lag bigint, {schema}")


PAIR_SUMS = "n bigint, sa double, sb double, saa double, sbb double, sab double"


def pair_sums(a: np.ndarray, b: np.ndarray) -> list[dict[str, float]]:
    """Sums from which a correlation over any number of tiles follows."""
    return [{"n": len(a), "sa": a.sum(), "sb": b.sum(), "saa": a @ a, "sbb": b @ b, "sab": a @ b}]


def pair_sums_by_label(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> list[dict[str, float]]:
    return [{"bin": int(k), **pair_sums(a[label == k], b[label == k])[0]} for k in np.unique(label)]


def corr_of_sums() -> Column:
    """Correlation from summed ``pair_sums``; null for fewer than two values or no spread."""
    n, sa, sb, saa, sbb, sab = (F.sum(c).cast("double") for c in ("n", "sa", "sb", "saa", "sbb", "sab"))
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    return F.when((n > 1) & (va > 0) & (vb > 0), (n * sab - sa * sb) / F.sqrt(va * vb))
