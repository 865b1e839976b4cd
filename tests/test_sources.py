"""Files, manifests, sinks and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelstrata.operators.frames import explode_tiles
from pixelstrata.sources import listings, manifests, raw_frames, raw_stacks, sinks
from pixelstrata.streaming import traces


def test_raw_frames_from_disk(spark, tmp_path):
    a = np.arange(6 * 5, dtype="<u2").reshape(6, 5)
    for f in (1, 2):
        (tmp_path / "7").mkdir(exist_ok=True)
        (a + f).astype("<u2").tofile(tmp_path / "7" / f"{f:03d}.raw")
    d = raw_frames.read_raw_files(spark, str(tmp_path)).withColumn("folder", F.element_at(F.split("path", "/"), -2).cast("bigint")).withColumn(
        "frame", listings.number_in(F.col("path")))
    px = explode_tiles(raw_frames.decode_raw_frames(d, ["folder", "frame"], 6, 5, roi=(1, 2, 3, 2)))
    got = {(r.frame, r.y, r.x): r.dn for r in px.collect()}
    assert got[(2, 1, 2)] == a[1, 2] + 2 and len(got) == 12
    with pytest.raises(Exception, match="expected 36"):
        raw_frames.decode_raw_frames(d, ["folder"], 6, 6).collect()


def test_stacks_read_only_the_region(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(1).integers(0, 65536, (7, 40, 30)).astype("<u2")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one.raw").write_bytes(b"HEAD" + a.tobytes())
    base = {"path": str(tmp_path), "height": "40", "width": "30", "header": "4", "roi": "5,2,30,9", "frames": "1:6"}
    read, at = [], raw_stacks.StackReader._at
    monkeypatch.setattr(raw_stacks.StackReader, "_at", staticmethod(lambda f, o, n: read.append(n) or at(f, o, n)))
    for gap, size in (("0", 5 * 30 * 9 * 2), ("4096", 5 * 30 * 30 * 2)):
        for partition in ("1000000", "100"):
            read.clear()
            r = raw_stacks.StackReader({**base, "gap_bytes": gap, "partition_bytes": partition})
            parts = r.partitions()
            tiles = [row for p in parts for b in r.read(p) for row in b.to_pylist()]
            assert sum(read) == size and (len(parts) > 20) == (partition == "100")
            got = np.zeros((7, 40, 30), np.int64)
            for t in tiles:
                got[t["frame"], t["top"] : t["top"] + t["h"], t["left"] : t["left"] + t["w"]] = np.reshape(t["dn"], (t["h"], t["w"]))
            want = np.zeros_like(got)
            want[1:6, 5:35, 2:11] = a[1:6, 5:35, 2:11]
            assert (got == want).all()


def test_stack_beyond_two_gigabytes(spark, tmp_path):
    side, n = 512, 4200  # 2.2 GB, a sparse file
    with open(tmp_path / "big.raw", "wb") as f:
        f.truncate(2 * side * side * n)
        f.seek(2 * side * (side * 4100 + 100))
        f.write(np.arange(side, dtype="<u2").tobytes())
    d = raw_stacks.read_stacks(spark, str(tmp_path), side, side, roi=(99, 10, 3, 4), frames=(4090, 4105))
    rows = {r.frame: r.dn for r in d.collect()}
    assert sorted(rows) == list(range(4090, 4105)) and rows[4100] == [0] * 4 + [10, 11, 12, 13] + [0] * 4 and sum(rows[4099]) == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = raw_stacks.read_stacks(spark, str(tmp_path), side, side, roi=(99, 10, 3, 4)).where("frame > 4098 and frame <= 4101 and frame in (7, 4100, 4101)")
        assert sorted(r.frame for r in few.collect()) == [4100, 4101] and few.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_stack_round_trip_and_damaged_files(spark, tmp_path):
    rows = [(f"{k % 3}/s.raw", k, [k, 2, 3, 65535]) for k in range(20)]
    raw_stacks.write_stacks(spark.createDataFrame(rows, "path string, frame bigint, dn array<bigint>"), str(tmp_path / "out"))
    got = sorted((r.path[-7:], r.frame, r.dn) for r in raw_stacks.read_stacks(spark, str(tmp_path / "out"), 2, 2).collect())
    assert got == sorted((p, k // 3, dn) for p, k, dn in rows) and not list((tmp_path / "out").glob(".tmp*"))
    assert raw_stacks.read_stacks(spark, str(tmp_path / "out"), 2, 2, frames=(50, 60)).count() == 0
    (tmp_path / "out" / "bad.raw").write_bytes(b"12345")
    with pytest.raises(Exception, match="no whole number"):
        raw_stacks.read_stacks(spark, str(tmp_path / "out"), 2, 2).collect()
    with pytest.raises(ValueError, match="does not lie"):
        raw_stacks.StackReader({"path": "x", "height": "4", "width": "4", "roi": "0,0,5,1"})


def test_listing_rejects_duplicates_and_other_suffixes(spark, tmp_path):
    for n in ("1-a.tif", "1-b.tif", "2.tif", "10.TIFF", "x.tif", "3.txt"):
        (tmp_path / n).write_text("x")
    files = listings.list_files(spark, str(tmp_path))
    rows = {r.frame_index: r.copies for r in listings.frame_listing(files, F.lit(1), listings.number_in(F.col("path")), [".tif", ".tiff"]).collect()}
    assert rows == {1: 2, 2: 1, 10: 1}


def test_pair_manifest(spark, tmp_path):
    p = tmp_path / "pairs.csv"
    p.write_text("﻿pair_key,clean_path,noisy_path,gain,note\nk1,c/1.tif,/n/1.tif,5,\n", encoding="utf-8")
    r = manifests.load_pair_manifest(spark, str(p), "/root").collect()[0]
    assert (r.pair_key, r.clean_path, r.noisy_path, r.metadata) == ("k1", "/root/c/1.tif", "/n/1.tif", {"gain": "5"})
    p.write_text("pair_key,clean_path\nk,c\n")
    with pytest.raises(ValueError, match="noisy_path"):
        manifests.load_pair_manifest(spark, str(p), "/root")


def test_split_manifest_and_unknown_keys(spark, tmp_path):
    p = tmp_path / "splits.yaml"
    p.write_text("# made by hand\ntrain:\n  - a  # first\n  - b\n\ntest:\n  - z\n")
    s = manifests.load_split_manifest(spark, str(p))
    assert [(r.split, r.ordinal, r.pair_key) for r in s.orderBy("split", "ordinal").collect()] == [("test", 0, "z"), ("train", 0, "a"), ("train", 1, "b")]
    pairs = spark.createDataFrame([("a", "c", "n")], "pair_key string, clean_path string, noisy_path string")
    found, unknown = manifests.resolve_split(pairs, s, "train")
    assert found.count() == 1 and [r.pair_key for r in unknown.collect()] == ["b"]


def test_exposure_lines(spark):
    lines = ["# note", "", "a/500ms/s_1.png b/2s/s_1.png", "a/2s/s_1.png b/1s/s_2.png", "only_one", "a/x/s.png b/1s/s.png"]
    d = manifests.exposure_pairs(spark.createDataFrame([(v,) for v in lines], "line string"))
    ok = d.where("problem IS NULL").collect()
    assert len(ok) == 1 and ok[0].pair_key == "s_1__noisy_500ms__clean_2s" and ok[0].exposure_ratio == 4.0
    assert sorted(r.problem for r in d.where("problem IS NOT NULL").collect()) == ["expected 2 paths", "no exposure", "stem mismatch"]


def test_log_lines(spark):
    good = "12-Camera1.tif Exposure delay:0ms, width:500ms Sync.A delay:-3ns, width:4us Sync.B delay:0ns, width:4us gain 80"
    swapped = "x.tif Sync.A delay:0ns, width:4us Exposure delay:0ms, width:1ms Sync.B delay:0ns, width:4us gain 1"
    rows = [(good,), ("broken",), (swapped,), (good.replace("12-Camera1", "my own frame 7"),), (good.replace("width:500ms ", " "),), (None,)]
    d = listings.acquisition_log(spark.createDataFrame(rows, "line string"), []).orderBy("filename").collect()
    assert [r.filename for r in d] == ["12-Camera1.tif", "my own frame 7.tif"]  # blanks belong to the name
    assert all((r.exposure_width_ms, r.sync_a_delay_ns, r.gain) == (500.0, -3.0, 80.0) for r in d)


def test_long_numbers_are_not_cut(spark):
    df = spark.createDataFrame([("a/img_12.tif",), ("a/img_1234567890123456789012.tif",), ("a/none.tif",)], "path string")
    assert [r[0] for r in df.select(listings.number_in(F.col("path"), "trailing")).collect()] == [12, None, None]


def test_strict_json(spark):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, float("inf"), None), (3, 1.5, "y")], "b int, a double, c string")
    rows = [json.loads(r.value) for r in sinks.json_rows(df).collect()]
    assert [list(r) for r in rows] == [["a", "b", "c"]] * 3
    assert [r["a"] for r in rows] == [None, None, 1.5] and rows[1]["c"] is None


def test_csv_union_column_order(spark):
    a = spark.createDataFrame([(1, "p")], "x int, k string")
    b = spark.createDataFrame([("q", 2)], "k string, z int")
    assert sinks.csv_union([a, b], ["k"]).columns == ["k", "x", "z"]


def arrive(spark, path, rows):
    """One more file of (time, folder, number) rows; later files are later batches."""
    import time

    time.sleep(1.1)  # the file source orders by modification time
    d = spark.createDataFrame(rows, "t string, folder string, value bigint").select(F.to_timestamp("t").alias("ts"), "folder", "value", F.col("value").alias("idx"))
    d.coalesce(1).write.mode("append").parquet(path)


def watched(spark, path):
    return traces.frame_stream(spark, path, spark.createDataFrame([], "ts timestamp, folder string, value bigint, idx bigint").schema, per_trigger=1)


def test_open_and_late_windows_over_a_restart(spark, tmp_path):
    path, place = str(tmp_path / "in"), str(tmp_path / "query")
    arrive(spark, path, [("2024-01-01 00:10:00", "a", 1), ("2024-01-01 05:00:00", "a", 3), (None, "a", 9), ("2024-01-01 05:00:00", None, 9)])
    arrive(spark, path, [("2024-01-01 06:00:00", "a", 4), ("2024-01-01 05:10:00", "a", 0)])
    now = lambda log: {(str(r.window_start), r.folder): (r.frames, r.mean, round(r.std, 6), r.zero_share, r.open) for r in traces.latest_windows(log).collect()}
    got = now(traces.drain(traces.trace_windows(watched(spark, path)), "late", place))
    assert got == {("2024-01-01 00:00:00", "a"): (1, 1.0, 0.0, 0.0, False), ("2024-01-01 05:00:00", "a"): (2, 1.5, 1.5, 0.5, True), ("2024-01-01 06:00:00", "a"): (1, 4.0, 0.0, 0.0, True)}
    arrive(spark, path, [("2024-01-01 00:20:00", "a", 100), ("2024-01-01 06:59:00", "a", 6), ("2024-01-01 09:00:00", "b", 5)])
    got = now(traces.drain(traces.trace_windows(watched(spark, path)), "late", place))
    assert got[("2024-01-01 06:00:00", "a")] == (2, 5.0, 1.0, 0.0, False) and got[("2024-01-01 00:00:00", "a")][:2] == (1, 1.0)
    assert got[("2024-01-01 05:00:00", "a")] == (2, 1.5, 1.5, 0.5, False) and got[("2024-01-01 09:00:00", "b")][4] is True


def test_stream_integrity_knows_late_duplicates_over_a_restart(spark, tmp_path):
    path, place = str(tmp_path / "in"), str(tmp_path / "query")
    arrive(spark, path, [("2024-01-01 00:00:00", "a", i) for i in (1, 2, 2, 5, 5000, -3)] + [("2024-01-01 00:00:00", "b", None)])
    now = lambda log: {(r.folder, r.bucket): (r.frames, r.first_idx, r.last_idx, r.gaps, r.duplicates, r.open) for r in traces.latest_ranges(log).collect()}
    got = now(traces.drain(traces.integrity(watched(spark, path)), "dup", place))
    assert got == {("a", 0): (3, 1, 5, 2, 1, True), ("a", 1): (1, 5000, 5000, 0, 0, True), ("a", -1): (1, -3, -3, 0, 0, True)}
    arrive(spark, path, [("2024-01-01 09:00:00", "a", 2), ("2024-01-01 09:00:00", "a", 3)])  # nine hours after the watermark has passed the first
    got = now(traces.drain(traces.integrity(watched(spark, path)), "dup", place))
    assert got == {("a", 0): (4, 1, 5, 1, 2, True), ("a", 1): (1, 5000, 5000, 0, 0, False), ("a", -1): (1, -3, -3, 0, 0, False)}


def test_stream_integrity_closes_each_range_of_a_lane_on_its_own(spark, tmp_path):
    path, far = str(tmp_path / "in"), traces.RANGE * traces.LANES
    arrive(spark, path, [("2024-01-01 00:00:00", "a", 1), ("2024-01-01 01:30:00", "a", far), ("2024-01-01 09:00:00", "a", 2 * far)])
    log = traces.drain(traces.integrity(watched(spark, path)), "lanes")
    assert {r.bucket: r.open for r in traces.latest_ranges(log).collect()} == {0: False, traces.LANES: False, 2 * traces.LANES: True}


def test_intervals_of_seen_numbers():
    rng = np.random.default_rng(0)
    for _ in range(50):
        starts = ends = np.zeros(0, np.int64)
        seen, repeats, given = set(), 0, 0
        for _ in range(6):
            v = rng.integers(0, 60, rng.integers(1, 20))
            starts, ends, again = traces.add_intervals(starts, ends, v)
            seen |= set(v.tolist())
            repeats, given = repeats + again, given + len(v)
        assert [x for a, b in zip(starts, ends) for x in range(a, b + 1)] == sorted(seen)
        assert (starts[1:] > ends[:-1] + 1).all() and repeats == given - len(seen)
