"""Fill-in-the-middle against a plain cut of a regular expression's units, and exact round trips."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pixelstrata.llm import fill_middle as M
from pyspark.sql import functions as F

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def check(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    got = M.transform(df).withColumn("back", M.restored()).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=repr) == sorted(((i, *brute(i, t), t or "") for i, t, *_ in rows), key=repr)


def test_odd_texts_equal_the_plain_cut(spark):
    odd = ["", None, "a", "abc def", "漢字 é́ ab", "<P", "<<S>", "x<M>y", "P>", "<S", "\n\r\n\t", "ａbc", "😀" * 40, "word " * 5000, "z" * 9000, "1" * 9000]
    check(spark, [(k, t) for k in range(40) for t in odd])


def test_null_ids_repeats_and_clashing_columns(spark):
    rows = [(None, "one two three", 1), (7, "four five", 2), (7, "four five", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumn("h1", F.lit(0)).withColumn("output", F.lit("x"))
    got = [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in M.transform(df).collect()]
    assert sorted(got, key=repr) == sorted((brute(i, t) for i, t, _ in rows), key=repr)
    assert M.transform(df.limit(0)).count() == 0


def test_long_text_over_several_windows(spark, monkeypatch):
    text = "".join(f"word{k}é, " for k in range(250_000))  # 3.5 MB
    check(spark, [(k, text) for k in range(3)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4000), max_size=400), st.integers(1, 60))
def test_index_is_exact_and_error_bounded(gaps, block):
    offsets = np.cumsum(np.array([3, *gaps], np.int64))
    index = M.RankIndex()
    for k in range(0, len(offsets), block):
        index.extend(offsets[k : k + block])
    index.close()
    assert index.at(np.arange(len(offsets))).tolist() == offsets.tolist()


def test_prose_needs_few_segments():
    raw = np.frombuffer(("lorem ipsum dolor sit amet consectetur " * 20_000).encode(), np.uint8)
    index, n = M._units(raw, np.array([0]), np.array([len(raw)]))
    assert index.size == int(n[0]) == 240_000 and len(index.first) < 100


@pytest.mark.parametrize("text", ["<P>a<S>b<M>c", "<S>", "a<P"])
def test_markers_in_texts_stay(spark, text):
    check(spark, [(k, text) for k in range(12)])


def test_query_equals_plain_cut_on_whole_table(spark, sf):
    from pixelstrata.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op12_fill_in_middle"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, form, prefix, middle, output = brute(r.doc_id, r.text)
        g, sha = got[r.doc_id], lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (g.n, g.form, g.prefix_chars, g.middle_chars, g.output_sha256, g.restored_sha256) == (n, form, prefix, middle, sha(output), sha(r.text or ""))
