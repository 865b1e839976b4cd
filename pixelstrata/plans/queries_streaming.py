"""Streams over the events table, drained to a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelstrata.functions.scalars import rnd
from pixelstrata.plans.registry import query
from pixelstrata.plans.views import Tables
from pixelstrata.streaming import traces


def event_stream(t: Tables):
    schema = t.read("events").schema
    s = traces.frame_stream(t.spark, f"{t.dir}/events*.parquet", schema)
    return s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("folder"), F.round(F.col("value") * 100).cast("bigint").alias("value"), F.col("event_id").alias("idx"))


@query("stream_trace_windows", """
    WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS folder, count(*) AS frames, avg(round(value * 100)) AS m, stddev_pop(round(value * 100)) AS s, avg((round(value * 100) = 0)::INT) AS z FROM events GROUP BY ALL)
    SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, folder, frames, R4(m) AS mean, R4(s) AS std, R6(z) AS zero_share, window_start + INTERVAL '2 hours' > (SELECT max(ts) FROM events) AS open FROM w""")
def _(t: Tables):
    d = traces.latest_windows(traces.drain(traces.trace_windows(event_stream(t)), "trace-windows"))
    return d.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "folder", "frames", rnd("mean", 4).alias("mean"), rnd("std", 4).alias("std"), rnd("zero_share", 6).alias("zero_share"), "open")


@query("stream_integrity", """
    WITH d AS (SELECT event_type AS folder, event_id AS idx, count(*) AS n, max(ts) AS ts FROM events GROUP BY ALL)
    SELECT folder, idx // 4096 AS bucket, count(*) AS frames, min(idx) AS first_idx, max(idx) AS last_idx, max(idx) - min(idx) + 1 - count(*) AS gaps, (sum(n) - count(*))::BIGINT AS duplicates,
      max(ts) >= (SELECT max(ts) FROM events) - INTERVAL '1 hour' AS open FROM d GROUP BY ALL""")
def _(t: Tables):
    return traces.latest_ranges(traces.drain(traces.integrity(event_stream(t)), "integrity"))
