"""Decontamination by an FM-index against windows compared one by one."""

import re
import string

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pixelstrata.llm import phrase_index as P

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=10):
    phrases = {}
    for i, t in items:
        w = split(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1) if n else ():
            phrases.setdefault(tuple(w[k : k + n]), set()).add(None if i is None else str(i))
    lengths, out = {len(p) for p in phrases}, []
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in phrases:
                    hit |= set(range(k, k + n))
                    names |= phrases[p] - {None}
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def found(spark, docs, items, width=10):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = P.hits(d, b, width).select("doc_id", "n_words", P.hit_words().alias("n_hit"), "items").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def prose(rng, n, kinds=40):
    return " ".join(f"w{x}" for x in rng.integers(0, kinds, n))


def test_planted_short_and_repeated_phrases(spark):
    rng = np.random.default_rng(1)
    items = [(k, prose(rng, int(rng.integers(1, 40)))) for k in range(12)] + [(30, "Tail-end, of A text"), (31, "tail END of a text"), (32, None), (33, "..."), (None, "w1 w2 w3"), (34, "été 漢字 x1"), (30, "w5 w5 w5 w5")]
    docs = []
    for k in range(60):
        body = prose(rng, int(rng.integers(0, 120)))
        item = items[int(rng.integers(0, 12))][1]
        docs.append((k, f"{body} {item.upper()}. {prose(rng, 5)}" if k % 2 else body))
    docs += [(100, None), (101, ""), (102, "!!"), (103, "tail end of a text"), (104, "Tail,end--of\na\ttext"), (105, "ÉTÉ 漢字 X1"), (106, "été 漢字 x1"), (5, docs[5][1]), (None, docs[7][1]), (107, "w5 " * 30)]
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("shard,block,window", [(1, 1, 64), (50, 7, 100), (300, 1 << 20, 1 << 20)])
def test_small_shards_blocks_and_windows(spark, monkeypatch, shard, block, window):
    """Cut texts, several passes and several shards give the same rows."""
    from pyspark import cloudpickle

    monkeypatch.setattr(P, "SHARD_WORDS", shard)
    monkeypatch.setattr(P, "BLOCK_WORDS", block)
    monkeypatch.setattr(P, "WINDOW", window)
    cloudpickle.register_pickle_by_value(P)  # tasks take the values set here
    try:
        rng = np.random.default_rng(2)
        items = [(k, prose(rng, 25, 6)) for k in range(6)] + [(9, "w0 w1")]
        docs = [(k, prose(rng, 30, 6) + " " + items[k % 6][1] + " " + prose(rng, 200, 6)) for k in range(14)] + [(50, None), (51, "x" * 500 + " w0 w1")]
        assert found(spark, docs, items) == brute(docs, items)
    finally:
        cloudpickle.unregister_pickle_by_value(P)


def test_spans_and_cleaned_text(spark):
    docs = spark.createDataFrame([(1, "é Start. One Two Three four! end"), (2, "one two three"), (3, "none"), (4, None)], "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    items = spark.createDataFrame([(7, "one two three"), (8, "three, FOUR")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in P.cleaned(docs, items).collect()}
    assert got == {1: ("é Start. ! end", 4), 2: ("", 3), 3: ("none", 0), 4: (None, 0)}


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5)], "doc_id long, text string, runs long").withColumn("items", F_lit())
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r)[:2] for r in P.hits(docs, items).collect()] == [(1, 3)]
    assert P.hits(docs.limit(0), items).count() == 0
    assert [r["items"] for r in P.hits(docs, items.limit(0)).collect()] == [[]]


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("x")


def test_long_text(spark):
    rng = np.random.default_rng(5)
    long = prose(rng, 600_000, 3000)
    item = " ".join(long.split(" ")[400_000:400_030])
    docs = [(1, long), (2, "y" * 3_000_000), (3, item)]
    rows = {r[0]: r[1:] for r in found(spark, docs, [(4, item)])}
    assert rows[1][:2] == (600_000, 30) and rows[2] == (1, 0, []) and rows[3] == (30, 30, ["4"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=40), min_size=1, max_size=8), st.lists(st.integers(0, 5), min_size=1, max_size=5))
def test_index_counts_and_positions(texts, pattern):
    index = P.FMIndex([np.array(t, np.uint64) for t in texts])
    lo, hi = index.search(np.array([pattern], np.uint64))
    at = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    want = [int(index.starts[k]) + a for k, t in enumerate(texts) for a in range(len(t) - len(pattern) + 1) if t[a : a + len(pattern)] == pattern]
    assert at == sorted(want)


def test_query_equals_brute_force_on_whole_table(spark, sf):
    from pixelstrata.llm.queries import QUERIES

    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select("doc_id" if name == "documents" else "item_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in QUERIES["op13_benchmark_decontamination"](spark, sf).collect()))
    assert got == [(i, n, h, len(s), h > 0) for i, n, h, s in sorted(brute(read("documents"), read("benchmark")))]
    assert any(r[4] for r in got)
