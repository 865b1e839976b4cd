"""Watching an acquisition while it runs: stateful processors with event-time timers.

Both streams append a log of changes to a table, exactly once; :func:`latest_windows` and
:func:`latest_ranges` reduce the log to the present state. Nothing is ever rewritten, nothing
is kept by the driver, and a stopped query goes on from its checkpoint.

A busy folder is spread over lanes, each with a state of its own: rows of a trace by a hash,
frame numbers by their range of ``RANGE`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pixelstrata.sources.storage import fresh_path

RANGE = 4096
LANES = 16
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[ms]").astype(np.int64)


def merged_moments(n1, mean1, m1, n2, mean2, m2):
    """Count, mean and sum of squared deviations of two parts together."""
    n = n1 + n2
    d = mean2 - mean1
    return n, mean1 + d * n2 / n, m1 + m2 + d * d * n1 * n2 / n


class WindowMoments(StatefulProcessor):
    """Moments of the windows of one (folder, lane): a row with ``open`` for every batch that adds to one, a last row when its time is over.

    The state holds the open windows only; the timer of the earliest end emits and drops what the watermark has passed.
    """

    NAMES = ["window_start", "window_end", "frames", "mean", "m2", "zeros"]

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("windows", "start array<bigint>, past array<bigint>, frames array<bigint>, mean array<double>, m2 array<double>, zeros array<bigint>")

    def _held(self) -> pd.DataFrame:
        values = [list(x) for x in self.state.get()] if self.state.exists() else [[] for _ in self.NAMES]
        return pd.DataFrame(dict(zip(self.NAMES, values))).astype({c: "float64" if c in ("mean", "m2") else "int64" for c in self.NAMES})

    def _hold(self, windows: pd.DataFrame) -> None:
        if len(windows):
            self.state.update(tuple(windows[c].tolist() for c in self.NAMES))
            self.handle.registerTimer(int(windows["window_end"].min()))
        else:
            self.state.clear()

    def _rows(self, key, windows: pd.DataFrame, open_: bool) -> pd.DataFrame:
        out = windows.assign(folder=key[0], lane=key[1], open=open_)
        return out[["folder", "lane", *self.NAMES, "open"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        touched, held = set(), self._held()
        for part in rows:
            v = part["value"].astype("float64")
            g = v.groupby([part["window_start"], part["window_end"]])
            new = pd.DataFrame({"frames": g.size(), "mean": g.mean(), "m2": g.var(ddof=0) * g.size(), "zeros": (v == 0).groupby([part["window_start"], part["window_end"]]).sum()}).reset_index()
            touched |= set(new["window_start"])
            both = held.merge(new, on=["window_start", "window_end"], how="outer", suffixes=("", "_2"))
            one, two = both["frames"].isna(), both["frames_2"].isna()
            n, mean, m2 = merged_moments(*(both[c].fillna(0) for c in ("frames", "mean", "m2", "frames_2", "mean_2", "m2_2")))
            zeros = both["zeros"].fillna(0) + both["zeros_2"].fillna(0)
            whole = pd.DataFrame({"window_start": both["window_start"], "window_end": both["window_end"], "frames": n, "mean": mean.where(~one, both["mean_2"]).where(~two, both["mean"]), "m2": m2, "zeros": zeros})
            held = whole.astype(held.dtypes)
        if touched:
            self._hold(held)
            yield self._rows(key, held[held["window_start"].isin(touched)], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        over = held["window_end"] <= timerValues.getCurrentWatermarkInMs()
        if over.any():
            yield self._rows(key, held[over], False)
            self._hold(held[~over])

    def close(self) -> None:
        pass


def trace_windows(events: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Log of tumbling-window moments of the stream (ts, folder, value), ends in milliseconds; rows later than ``delay`` are dropped.

    Rows without ts, folder or value are left out.
    """
    w = events.where("ts is not null and folder is not null and value is not null").withWatermark("ts", delay).select(
        "ts", "folder", "value", F.window("ts", width).alias("_w"), F.pmod(F.xxhash64("ts", "value"), F.lit(LANES)).cast("int").alias("lane"))
    rows = w.select("ts", "folder", "value", F.unix_millis("_w.start").alias("window_start"), F.unix_millis("_w.end").alias("window_end"), "lane")
    schema = f"folder {dict(rows.dtypes)['folder']}, lane int, window_start bigint, window_end bigint, frames bigint, mean double, m2 double, zeros bigint, open boolean"
    return rows.groupBy("folder", "lane").transformWithStateInPandas(WindowMoments(), schema, "Append", "EventTime")


def latest_windows(log: DataFrame) -> DataFrame:
    """Count, mean, population std and zero share of each window so far; ``open`` while rows may still come."""
    key = ["folder", "window_start", "window_end"]
    lanes = log.groupBy(*key, "lane").agg(F.max_by(F.struct("frames", "mean", "m2", "zeros"), "frames").alias("s"), F.min("open").alias("open"))
    n = F.sum("s.frames")
    mean = F.sum(F.col("s.mean") * F.col("s.frames")) / n
    total = lanes.groupBy(*key).agg(n.alias("frames"), mean.alias("mean"), F.sum("s.zeros").alias("zeros"), F.max("open").alias("open"))
    spread = lanes.join(total.select(*key, F.col("mean").alias("_m")), key).groupBy(*key).agg(F.sum(F.col("s.m2") + F.col("s.frames") * F.pow(F.col("s.mean") - F.col("_m"), 2)).alias("m2"))
    return total.join(spread, key).select(
        F.timestamp_millis("window_start").alias("window_start"), F.timestamp_millis("window_end").alias("window_end"), "folder", "frames", "mean", F.sqrt(F.col("m2") / F.col("frames")).alias("std"), (F.col("zeros") / F.col("frames")).alias("zero_share"), "open")


def batch_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """The same statistics of a finished table (ts, folder, value)."""
    g = events.where("ts is not null and folder is not null").groupBy(F.window("ts", width), "folder").agg(
        F.count("value").alias("frames"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.avg((F.col("value") == 0).cast("double")).alias("zero_share"))
    return g.where("frames > 0").select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "folder", "frames", "mean", "std", "zero_share")


def add_intervals(starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Closed intervals after adding whole numbers, and how many of the numbers were there already.

    Intervals are sorted, disjoint and not adjacent; ``values`` may repeat and come in any order.
    """
    new = np.unique(values)
    at = np.searchsorted(starts, new, "right") - 1
    known = (at >= 0) & (new <= ends[np.maximum(at, 0)]) if len(starts) else np.zeros(len(new), bool)
    fresh = new[~known]
    repeats = len(values) - len(fresh)
    if not len(fresh):
        return starts, ends, repeats
    cut = np.flatnonzero(np.diff(fresh) > 1)
    a = np.concatenate([starts, fresh[np.concatenate([[0], cut + 1])]])
    b = np.concatenate([ends, fresh[np.concatenate([cut, [len(fresh) - 1]])]])
    order = np.argsort(a)
    a, b = a[order], b[order]
    apart = np.flatnonzero(a[1:] > b[:-1] + 1)
    return a[np.concatenate([[0], apart + 1])], b[np.concatenate([apart, [len(b) - 1]])], repeats


class SeenRanges(StatefulProcessor):
    """Frame numbers seen by one (folder, lane), as an interval list, for good.

    A lane holds every ``LANES``-th range of ``RANGE`` numbers; laid end to end these are again
    whole numbers in order, so complete ranges run together into one interval and the state has
    one interval more than there are open gaps, however long the acquisition. A number that comes
    again is known at any distance in time. A timer closes a range once no new frame has come for
    the allowed delay; of a lane's open ranges the one that ends first sets it.
    """

    def init(self, handle):
        self.handle = handle
        self.seen = handle.getValueState("seen", "starts binary, ends binary")
        self.open = handle.getMapState("open", "slot bigint", "last bigint")

    def _intervals(self):
        if not self.seen.exists():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.frombuffer(x, np.int64) for x in self.seen.get())

    def _rows(self, key, slots, repeats, open_):
        folder, lane = key
        starts, ends = self._intervals()
        out = []
        for slot in slots:
            lo, hi = slot * RANGE, slot * RANGE + RANGE - 1
            a, b = np.searchsorted(ends, lo), np.searchsorted(starts, hi, "right")
            if a >= b:
                continue
            first, last = np.maximum(starts[a:b], lo), np.minimum(ends[a:b], hi)
            base = (slot * LANES + lane) * RANGE - lo
            out.append((folder, slot * LANES + lane, int((last - first + 1).sum()), int(first[0] + base), int(last[-1] + base), repeats.get(slot, 0), open_))
        return pd.DataFrame(out, columns=["folder", "bucket", "frames", "first_idx", "last_idx", "duplicates", "open"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        starts, ends = self._intervals()
        repeats: dict[int, int] = {}
        last: dict[int, int] = {}
        for part in rows:
            at, ts = part["at"].to_numpy(np.int64), _ms(part["ts"])
            slot = at // RANGE
            for s in np.unique(slot):
                mine = slot == s
                starts, ends, again = add_intervals(starts, ends, at[mine])
                repeats[int(s)] = repeats.get(int(s), 0) + again
                last[int(s)] = max(last.get(int(s), 0), int(ts[mine].max()))
        if not last:
            return
        self.seen.update((starts.tobytes(), ends.tobytes()))
        for s, ms in last.items():
            known = int(self.open.getValue((s,))[0]) if self.open.containsKey((s,)) else 0
            self.open.updateValue((s,), (max(ms, known),))
        self.handle.registerTimer(min(last.values()) + 1)
        yield self._rows(key, sorted(last), repeats, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        pending = {int(k[0]): int(v[0]) for k, v in self.open.iterator()} if self.open.exists() else {}
        done = sorted(s for s, ms in pending.items() if ms < now)
        for s in done:
            self.open.removeKey((s,))
        if rest := [ms for ms in pending.values() if ms >= now]:
            self.handle.registerTimer(min(rest) + 1)
        if done:
            yield self._rows(key, done, {}, False)

    def close(self) -> None:
        pass


def integrity(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Log of what is known of each range of frame numbers of the stream (ts, folder, idx); rows without one of them are left out."""
    bucket = F.floor(F.col("idx") / RANGE).cast("bigint")
    rows = events.where("ts is not null and folder is not null and idx is not null").withWatermark("ts", delay).select(
        "ts", "folder", F.pmod(bucket, F.lit(LANES)).cast("int").alias("lane"),
        (F.floor(bucket / LANES) * RANGE + F.pmod(F.col("idx"), F.lit(RANGE))).cast("bigint").alias("at"))
    schema = f"folder {dict(rows.dtypes)['folder']}, bucket bigint, frames bigint, first_idx bigint, last_idx bigint, duplicates bigint, open boolean"
    return rows.groupBy("folder", "lane").transformWithStateInPandas(SeenRanges(), schema, "Append", "EventTime")


def latest_ranges(log: DataFrame) -> DataFrame:
    """Frames, ends, gaps inside and duplicates of each range so far; ``open`` until its timer has fired after the last new row."""
    at = F.struct("frames", (~F.col("open")).alias("closed"))
    d = log.groupBy("folder", "bucket").agg(F.max_by(F.struct("frames", "first_idx", "last_idx", "open"), at).alias("s"), F.sum("duplicates").alias("duplicates"))
    gaps = (F.col("last_idx") - F.col("first_idx") + 1 - F.col("frames")).alias("gaps")
    return d.select("folder", "bucket", "s.frames", "s.first_idx", "s.last_idx", "duplicates", "s.open").select("folder", "bucket", "frames", "first_idx", "last_idx", gaps, "duplicates", "open")


def frame_stream(spark: SparkSession, pattern: str, schema, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(pattern)


def drain(stream: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """Run the stream over what is there (append, exactly once) and read the log table.

    With a ``location`` that was used before, the query goes on where it stopped.
    """
    spark = stream.sparkSession
    base = location or fresh_path(spark, name)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKS)  # the state of these processors needs it
    try:
        q = stream.writeStream.format("parquet").option("path", f"{base}/log").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/log")
