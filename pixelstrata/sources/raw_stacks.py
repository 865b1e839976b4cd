"""Headerless 16-bit frame stacks as a Spark data source that reads byte ranges.

A file holds one frame or many, one after the other, of ``height`` x ``width`` little-endian
uint16 pixels after ``header`` bytes. The reader lists files with their sizes only, and plans
partitions of about ``partition_bytes`` from (file, frames, rows of the region). Wanted frames
and the region go into the plan: other bytes are not read, a file of any size is never one
row, and a frame larger than a partition comes as several tiles of rows.

    spark.dataSource.register(RawStacks)
    spark.read.format("raw_stack").option("height", 512).option("width", 512) \\
        .option("roi", "128,128,256,256").option("frames", "0:100").load("/data/stacks")

Rows are (path, frame, top, left, h, w, dn); ``frame`` counts from 0 in its file. Filters on
``frame`` are pushed down too with the option ``pushdown``, which needs
``spark.sql.python.filterPushdown.enabled``. The writer takes
(path, frame, dn) rows, sorted by path and frame inside their partition, one file for each path.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

SCHEMA = "path string, frame bigint, top int, left int, h int, w int, dn array<bigint>"
SUFFIX = ".raw"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, and those of pyarrow: s3, gs, abfs, hdfs)."""
    local = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(local if "://" in local else os.path.abspath(local))


@dataclass
class Span(InputPartition):
    """Frames [first, past) of one file, rows [top, top + rows) of each."""

    path: str
    first: int
    past: int
    top: int
    rows: int


@dataclass
class Layout:
    height: int
    width: int
    header: int
    roi: tuple[int, int, int, int]
    partition_bytes: int
    gap_bytes: int

    @classmethod
    def of(cls, options) -> Layout:
        h, w = int(options["height"]), int(options["width"])
        roi = tuple(int(x) for x in options["roi"].split(",")) if options.get("roi") else (0, 0, h, w)
        top, left, rows, columns = roi
        if min(h, w, rows, columns) < 1 or min(top, left) < 0 or top + rows > h or left + columns > w:
            raise ValueError(f"region {roi} does not lie in frames of {h} x {w}")
        return cls(h, w, int(options.get("header", 0)), roi, int(options.get("partition_bytes", 64 << 20)), int(options.get("gap_bytes", 4096)))

    def frames(self, path: str, size: int) -> int:
        """Frames of a file; a file that does not end with a whole frame is an error, not a short result."""
        n, rest = divmod(size - self.header, 2 * self.height * self.width)
        if rest or n < 0:
            raise ValueError(f"{path} has {size} bytes, which is no whole number of {self.height} x {self.width} frames")
        return n

    @property
    def whole_rows(self) -> bool:
        """Rows are read with the pixels beside the region where that costs less than another request."""
        return 2 * (self.width - self.roi[3]) <= self.gap_bytes


class StackReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.layout = options["path"], Layout.of(options)
        lo, _, hi = options.get("frames", ":").partition(":")
        self.first, self.past = int(lo or 0), int(hi) if hi else None
        self.chosen: set[int] | None = None

    def _runs(self, n: int) -> Iterator[tuple[int, int]]:
        """Runs of wanted frames among n."""
        first, past = self.first, n if self.past is None else min(n, self.past)
        if self.chosen is None:
            if first < past:
                yield first, past
            return
        some = np.array(sorted(k for k in self.chosen if first <= k < past), np.int64)
        for run in np.split(some, np.flatnonzero(np.diff(some) > 1) + 1):
            if len(run):
                yield int(run[0]), int(run[-1]) + 1

    def partitions(self) -> list[Span]:
        fs, base = file_system(self.path)
        top_info = fs.get_file_info(base)
        if top_info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [top_info] if top_info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith(SUFFIX)]
        layout = self.layout
        top, _, rows, columns = layout.roi
        row_bytes = 2 * (layout.width if layout.whole_rows else columns)
        out = []
        for f in sorted(files, key=lambda f: f.path):
            for first, past in self._runs(layout.frames(f.path, f.size)):
                if rows * row_bytes > layout.partition_bytes:
                    step = max(1, layout.partition_bytes // row_bytes)
                    out += [Span(f.path, k, k + 1, a, min(step, top + rows - a)) for k in range(first, past) for a in range(top, top + rows, step)]
                else:
                    step = layout.partition_bytes // (rows * row_bytes)
                    out += [Span(f.path, k, min(k + step, past), top, rows) for k in range(first, past, step)]
        return out or [Span("", 0, 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.past:
            return
        layout, (_, left, _, columns) = self.layout, self.layout.roi
        schema = pa.schema([("path", pa.string()), ("frame", pa.int64()), *((k, pa.int32()) for k in ("top", "left", "h", "w")), ("dn", pa.list_(pa.int64()))])
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as file:
            for k in range(partition.first, partition.past):
                start = layout.header + 2 * layout.width * (k * layout.height + partition.top)
                if layout.whole_rows:
                    block = np.frombuffer(self._at(file, start, 2 * layout.width * partition.rows), "<u2").reshape(partition.rows, layout.width)[:, left : left + columns]
                else:
                    block = np.stack([np.frombuffer(self._at(file, start + 2 * (r * layout.width + left), 2 * columns), "<u2") for r in range(partition.rows)])
                row = [[partition.path], [k], [partition.top], [left], [partition.rows], [columns]]
                pixels = pa.ListArray.from_arrays(pa.array([0, block.size], pa.int32()), pa.array(block.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*(pa.array(v, t.type) for v, t in zip(row, schema)), pixels], schema=schema)

    @staticmethod
    def _at(file, offset: int, size: int) -> bytes:
        data = file.read_at(size, offset)
        if len(data) != size:
            raise EOFError(f"{size} bytes wanted at {offset}, {len(data)} found")
        return data


class FilteringReader(StackReader):
    """Takes filters on ``frame`` into the plan; Spark refuses such a reader where its setting for this is off."""

    def pushFilters(self, filters):
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("frame",) or not isinstance(value, (int, tuple)):
                yield f
            elif isinstance(f, (EqualTo, In)):
                some = {value} if isinstance(f, EqualTo) else set(value)
                self.chosen = some if self.chosen is None else self.chosen & some
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                past = value + isinstance(f, LessThanOrEqual)
                self.past = past if self.past is None else min(self.past, past)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    """Temporary name and name of each file of a task."""

    files: list[tuple[str, str]]


class StackWriter(DataSourceArrowWriter):
    """Tasks write under names of their own; only the commit gives files their names, so a task that ran twice leaves one copy."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator) -> Written:
        fs, base = file_system(self.path)
        files, out, now, frame = [], None, None, None
        try:
            for batch in iterator:
                for path, k, dn in zip(batch["path"].to_pylist(), batch["frame"].to_pylist(), batch["dn"]):
                    if path != now:
                        if out is not None:
                            out.close()
                        name, now, frame = f"{base}/{path}", path, None
                        files.append((f"{base}/.tmp-{uuid.uuid4().hex}", name))
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(files[-1][0])
                    if frame is not None and k <= frame:
                        raise ValueError(f"frame {k} of {path} comes after frame {frame}: sort the rows by path and frame")
                    frame = k
                    out.write(np.asarray(dn.values, dtype="<u2").tobytes())
        finally:
            if out is not None:
                out.close()
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            raise ValueError("rows of one path are not together: sort the rows by path and frame")
        return Written(files)

    def commit(self, messages) -> None:
        fs, _ = file_system(self.path)
        names = [name for m in messages if m for _, name in m.files]
        if len(set(names)) < len(names):
            raise ValueError("one path was written by several tasks: repartition by path")
        for m in messages:
            for temporary, name in m.files if m else ():
                fs.create_dir(os.path.dirname(name), recursive=True)
                fs.move(temporary, name)

    def abort(self, messages) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            for temporary, _ in m.files if m else ():
                fs.delete_file(temporary)


class RawStacks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_stack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StackReader:
        return FilteringReader(self.options) if self.options.get("pushdown") == "true" else StackReader(self.options)

    def writer(self, schema, overwrite: bool) -> StackWriter:
        return StackWriter(self.options)


def read_stacks(spark: SparkSession, path: str, height: int, width: int, roi: tuple[int, int, int, int] | None = None, frames: tuple[int, int] | None = None, **options: int) -> DataFrame:
    """Tiles of a region of some frames [first, past) of all stacks below ``path``."""
    spark.dataSource.register(RawStacks)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    r = spark.read.format("raw_stack").option("height", height).option("width", width).option("pushdown", pushdown)
    if roi:
        r = r.option("roi", ",".join(map(str, roi)))
    if frames:
        r = r.option("frames", f"{frames[0]}:{frames[1]}")
    for key, value in options.items():
        r = r.option(key, value)
    return r.load(path)


def write_stacks(frames: DataFrame, path: str) -> None:
    """Write (path, frame, dn) rows as one raw file for each ``path``, frames in order."""
    frames.sparkSession.dataSource.register(RawStacks)
    rows = frames.select("path", "frame", F.col("dn").cast("array<bigint>").alias("dn")).repartition("path").sortWithinPartitions("path", "frame")
    rows.write.format("raw_stack").mode("append").save(path)
