"""Near-duplicate documents against all pairs compared one by one."""

import re
import string

import pytest
from hypothesis import given, settings, strategies as st
import numpy as np
import pyarrow as pa

from pixelstrata.functions import byte_spans as B
from pixelstrata.llm import tensor_minhash as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, width, percent):
    """{doc_id: (size, component)} by comparing every pair."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t, width))
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                u, v = root(a), root(b)
                label[max(u, v)] = min(u, v)
    return {i: root(i) for i in ids}


def words(n, seed):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n)]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_groups_match_all_pairs(spark, width, percent):
    rows, rng = [], np.random.default_rng(3)
    for g in range(12):  # groups around a base text, from equal to half changed
        base = words(120, g)
        for k in range(10):
            copy = list(base)
            for at in rng.choice(120, k // 2, replace=False):
                copy[at] = f"x{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "é one"), (907, "É one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in T.near_duplicates(df, width, percent).collect()}
    want = brute(rows, width, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    assert all(got[i].n_shingles == len(shingle_set(t, width)) for i, t in rows)


def test_hot_group_of_near_copies_and_outliers(spark):
    """A table of hundreds of members, many of them not linked to its smallest member."""
    base, rng, rows = words(80, 1), np.random.default_rng(9), []
    for k in range(700):
        copy = list(base)
        for at in rng.choice(80, rng.integers(0, 5), replace=False):
            copy[at] = f"y{rng.integers(10**6)}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in T.near_duplicates(df, 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_repeats_null_ids_extra_columns_and_empty(spark):
    long = " ".join(words(60_000, 4))
    rows = [(1, "a b c d", 5), (1, "a b c d", 6), (2, "a b c d", 7), (None, "a b c d", 8), (3, long, 9), (4, long + " end", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept long").withColumnRenamed("kept", "component_id")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in T.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 3, False)], key=str)
    kept = T.drop_near_duplicates(df, 3, 85)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]
    empty = T.near_duplicates(df.limit(0), 3, 85)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_query_equals_all_pairs_on_whole_table(spark, sf):
    from pixelstrata.llm.queries import QUERIES

    got = {r.doc_id: r.component_id for r in QUERIES["op8_minhash_near_dedup"](spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(rows, 3, 85)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAé \n\t\x0b.漢", max_size=30)), max_size=12), st.integers(1, 40))
def test_words_of_slices(texts, size):
    column = pa.array(texts, pa.string())
    seen, rows = {}, []
    for part in B.slices(column, size):
        h, opens, closes, counts = B.words(part)
        flat = [bytes(part.raw[a:b]).decode().translate(LOWER) for a, b in zip(opens, closes)]
        for w, x in zip(flat, h):
            assert seen.setdefault(w, x) == x
        for n in counts:
            rows.append(flat[:n])
            flat = flat[n:]
    assert rows == [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert len(set(seen.values())) == len(seen)
