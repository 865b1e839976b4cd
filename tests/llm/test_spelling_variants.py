"""Spelling variants against all pairs of words, and neighbourhoods against their definition."""

import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from pixelstrata.functions.byte_spans import slices
from pixelstrata.llm import spelling_variants as V

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(rows, deleted=31):
    count = Counter()
    for i, text in rows:
        for w in RUN.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % deleted == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(rows, deleted=31):
    n = words_of(rows, deleted)
    near = {w: [] for w in n}
    kinds = {}
    for w in n:  # words one apart share a half at its place from the start or from the end
        for key in {(0, w[: len(w) // 2 - 1]), (1, w[-(len(w) // 2 - 1) :])}:
            kinds.setdefault(key, []).append(w)
    for a in n:
        for b in {b for size in (len(a) - 1, len(a), len(a) + 1) for half in [max(1, size // 2 - 1)] for key in [(0, a[:half]), (1, a[-half:])] for b in kinds.get(key, ())}:
            if one_apart(a, b):
                near[a].append(b)
    form = {}
    for w, all_near in near.items():
        best = min(all_near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]])
    return out


def found(spark, rows, **given):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = V.variants(df, **given).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def corpus(seed, kinds=60, rows=120):
    rng = np.random.default_rng(seed)
    letters = list("aAbcdeéÉßÿ÷×")
    base = ["".join(rng.choice(letters, rng.integers(7, 13))) for _ in range(kinds)]
    rows_out = []
    for k in range(rows):
        text = []
        for _ in range(60):
            w = list(base[min(kinds - 1, int(rng.exponential(8)))])
            if rng.random() < 0.2:
                at = rng.integers(len(w))
                w[at : at + rng.integers(0, 2)] = list(rng.choice(letters, rng.integers(0, 2)))
            text.append("".join(w))
        rows_out.append((k, " 1-".join(text)))
    return rows_out


def test_groups_match_all_pairs(spark):
    rows = corpus(1) + [(900, None), (901, ""), (902, "1234 ..."), (None, "lonesome lonesome")]
    want = brute(rows)
    assert found(spark, rows) == want and any(v[0] for v in want.values())


def test_few_symbols_and_a_full_bitmap_lose_nothing(spark):
    rows = corpus(2, 30, 60)
    want = brute(rows)
    assert found(spark, rows, symbols=2, bits=4) == want == found(spark, rows, symbols=1, bits=16)


def test_chains_ties_and_hot_words(spark):
    a, b, c = "xaaaaaaa", "xxaaaaaaa", "xxxaaaaaaa"
    text = lambda w, n: " ".join([w] * n)
    rows = [(k, text(a, 2)) for k in range(3)] + [(10, text(b, 90)), (11, text(c, 2000)), (12, text("tiewordz", 3)), (13, text("tieworda", 40)), (14, text("tiewordb", 40)), (15, text("tieword", 2))]
    want = brute(rows, deleted=10**9)
    got = found(spark, rows, deleted=10**9)
    assert got == want and got[a][1] == c and got["tiewordz"][0] == "tieworda"


def test_very_long_words_and_empty_tables(spark):
    long = "ab" * 200_000
    rows = [(1, f"{long} {long} x{long} X{long} shorter words"), (2, f"{long[:-1]}z " * 2)]
    got = found(spark, rows, deleted=10**9)
    assert {(w[-1], len(w)): v[3] for w, v in got.items()} == {("b", 400_000): 2, ("z", 400_000): 1, ("b", 400_001): 1}
    df = spark.createDataFrame([], "doc_id long, text string")
    assert V.variants(df).count() == 0
    assert V.variants(spark.createDataFrame([(1, "too few", 2)], "doc_id long, text string, word long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aBcÀÿéz÷ .漢ż\n", max_size=40), max_size=6), st.integers(1, 5))
def test_counts_of_slices(texts, deleted):
    rows = list(enumerate(texts))
    got = Counter()
    for part in slices(pa.array(texts, pa.string()), 30):
        ids = [str(i) for i, _ in rows[part.first : part.first + len(part.starts)]]
        for w, n in zip(*V.counted(part, ids, 2, deleted)):
            got[w.decode()] += n
    want = Counter()
    for i, text in rows:
        for w in RUN.findall(text):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % deleted == 0 else w] += 1
    assert got == Counter({w: n for w, n in want.items() if len(w) >= 2})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=7), min_size=1, max_size=4))
def test_neighbourhood_is_whole(words):
    def keys(some):
        flat = np.array([x for w in some for x in w], np.uint64)
        size = np.array([len(w) for w in some])
        ends = np.cumsum(size)
        return flat, ends - size, ends

    def key(w):
        total = sum(x * pow(V._BASE, k, 1 << 64) for k, x in enumerate(w)) % (1 << 64)
        return int(V._key(np.array([total], np.uint64), np.array([len(w)]))[0])

    got = {}
    for row, k in V.neighbours(*keys(words), 3):
        for r, x in zip(row.tolist(), k.tolist()):
            got.setdefault(r, set()).add(x)
    for r, w in enumerate(words):
        edits = {tuple(w)} | {tuple(w[:k] + w[k + 1 :]) for k in range(len(w))}
        edits |= {tuple(w[:k] + [s] + w[k + j :]) for k in range(len(w) + 1) for j in (0, 1) for s in (1, 2, 3) if k + j <= len(w)}
        assert got[r] == {key(e) for e in edits}


def test_query_equals_all_pairs_on_whole_table(spark, sf):
    from pixelstrata.llm.queries import QUERIES

    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op11_spelling_variants"](spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(rows)
