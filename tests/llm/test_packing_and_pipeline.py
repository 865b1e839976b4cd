"""Packing: exact round trips and bounds; the pipeline against its stages done by hand."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pixelstrata.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def encoder():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, packed, capacity=1024):
    """Every piece once, gapless sequences, ids as the tokenizer gives them."""
    ids = encoder()
    want = sorted((i, k, s, n, zlib.crc32(np.array(ids(t)[s : s + n], "<u4"))) for i, t in rows for k, (s, n) in enumerate(P.cuts(len(ids(t)), capacity)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_cuts():
    assert P.cuts(5, 8) == [(0, 5)] and P.cuts(8, 8) == [(0, 8)] and P.cuts(16, 8) == [(0, 8), (8, 8)] and P.cuts(19, 8) == [(0, 3), (3, 8), (11, 8)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_patterns_place_every_length_once(lengths):
    counts = dict(zip(*map(lambda x: x.tolist(), np.unique(lengths, return_counts=True)))) if lengths else {}
    patterns = P.bin_patterns(counts, 24)
    placed = {}
    for used, times in patterns:
        assert sum(n * c for n, c in used.items()) <= 24 and times > 0
        for n, c in used.items():
            placed[n] = placed.get(n, 0) + c * times
    assert placed == counts and len(patterns) <= 24
    bins = sum(t for _, t in patterns)
    assert bins <= max(1, 2 * -(-sum(lengths) // 24)) if lengths else bins == 0


def test_smallest_gives_way_to_two():
    # greedy takes 6 + 3 and leaves a gap of 1; 6 + 2 + 2 fills the bin
    patterns = P.bin_patterns({6: 1, 3: 1, 2: 2}, 10)
    assert patterns[0] == ({6: 1, 2: 2}, 1)


def test_ids_agree_between_both_encoders():
    e = P.Encoder.of(PATH)
    assert e.fast is not None
    texts = ["", "Hello  world\n\n\tx's don't", "éàü ß ñ 12345 %%% *** <|endoftext|>", "a" * 5000, "    x", "naïve—dash", "x\r\n y"]
    for t in texts:
        want = e.whole.encode(t, add_special_tokens=False).ids
        assert e.ids(t, True).tolist() == want and e.ids(t, False).tolist() == want
    assert e.ids("漢字 и кириллица 🙂", False).tolist() == e.whole.encode("漢字 и кириллица 🙂", add_special_tokens=False).ids


def test_odd_rows_and_sequences(spark):
    rows = [(1, None), (2, ""), (3, "word " * 3000), (3, "word " * 3000), (4, "same"), (4, "same"), (5, "漢字" * 40)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, length int, offset string")
    packed = P.pack(df, PATH, keep_ids=True)
    check(rows, packed.collect())
    whole = P.sequences(packed).collect()
    assert sum(len(r.input_ids) for r in whole) == sum(len(encoder()(t)) for _, t in rows)
    assert P.pack(df.limit(0), PATH).count() == 0
    assert P.pack(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"), PATH).count() == 2


def test_query_on_whole_table(spark, sf):
    from pixelstrata.llm.queries import QUERIES

    packed = QUERIES["op6_best_fit_packing"](spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bins = check(rows, packed)
    assert bins <= -(-sum(r.length for r in packed) // 1024) * 1.02 + 1


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    from pixelstrata.llm import language_models, quality
    from test_minhash import brute

    sf = "/root/testdata/sf0.01"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "minhash_near_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    good = [r for r in docs.collect() if scores[r.doc_id] == 1]
    rejected = {r.doc_id for r in language_models.languages(spark.createDataFrame(good, docs.schema)).where("rejected").collect()}
    rows = [(r.doc_id, r.text) for r in good if r.doc_id not in rejected]
    component = brute(rows, 5, 80)
    rows = [(i, t) for i, t in rows if component[i] == i]
    check(rows, corpus_pipeline.run(spark, sf).collect())
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    wanted = set(labels[labels["quality"] == 1]["doc_id"])
    assert len(wanted & {r.doc_id for r in good}) >= 0.98 * len(wanted)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_take_odd_rows(spark, sf, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (None, "", "en", "x", 0), (-2, " ", None, "x", 1), (-2, " ", None, "x", 1)], docs.schema)
    out = stage(spark, docs.unionByName(odd), sf)
    if k < 3:
        assert out.columns == docs.columns
        out.collect()
    else:
        assert out.where("doc_id < 0 or doc_id is null").count() == 4
    assert stage(spark, docs.limit(0), sf).count() == 0


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\r\n", "\xa0", " \t"])
def test_long_runs_of_blanks_give_the_library_s_ids(blank):
    encoder = P.Encoder.of(PATH)
    run = blank * (1_100_000 // len(blank))
    for text in (run, "a" + run + "b c", run + "don't", "x  y" + run, "a" + run + " b" + run + "!"):
        assert np.array_equal(encoder.ids(text, True), encoder.ids(text, False))


def test_twenty_million_blanks(spark):
    rows = [(1, " " * 20_000_000 + "a"), (2, "b")]
    got = P.pieces(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {1: 20_000_001, 2: 2}
