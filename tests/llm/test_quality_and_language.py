"""Held-out accuracy of the two classifiers, their numerical parts against plain versions, and odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelstrata.llm import language_models as L, quality as Q


def test_quality_held_out(spark):
    from pixelstrata.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    out = QUERIES["op1_quality_classifier"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    held = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("h")).toPandas().set_index("doc_id")["h"]
    assert (out.set_index("doc_id")["held_out"] == held).all()
    both = out[out["held_out"]].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (both["predicted"] == both["quality"]).mean() > 0.95


def test_normal_equations_and_pooling(spark):
    rng = np.random.default_rng(0)
    facts, y = rng.normal(size=(50, len(Q.NAMES))), rng.integers(0, 2, 50).astype(float)
    none = np.zeros(0)
    model = Q.Model(np.zeros(len(Q.NAMES)), np.ones(len(Q.NAMES)), rng.normal(size=(len(Q.NAMES), 7)), rng.uniform(size=7), none, none, none)
    df = spark.createDataFrame([(x.tolist(), float(t)) for x, t in zip(facts, y)], "facts array<double>, y double").repartition(5)
    gram, target = Q.normal_equations(df, model)
    z = model.features(facts)
    assert np.allclose(gram, z.T @ z) and np.allclose(target, z.T @ y)
    fit = Q.pooled(np.ones(6), np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8]))
    assert np.allclose(fit, [0.1, 1 / 3, 1 / 3, 1 / 3, 0.85, 0.85])


def test_quality_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "Some words here.", "x"), (3, "word " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    out = Q.quality_scores(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    none = Q.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    assert Q.quality_scores(docs.limit(0), labels).count() == 0
    assert Q.keep_good(docs, labels.limit(0)).columns == docs.columns and Q.keep_good(docs, labels.limit(0)).count() == 5


def kneser_ney(texts, order):
    """Probability function of an interpolated Kneser-Ney model, from its definition."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [0] * (order - 1) + [ord(c) for c in t]
        for k in range(order - 1, len(s)):
            counts[order][tuple(s[k - order + 1 : k + 1])] += 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    size = len({g[-1] for g in counts[order]}) + 1

    def probability(g):
        if not g:
            return 1 / size
        c = counts[len(g)]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.05
        under = {h: v for h, v in c.items() if h[:-1] == g[:-1]}
        if not under:
            return probability(g[1:])
        total = sum(under.values())
        return max(c[g] - d, 0) / total * (g in c) + d * len(under) / total * probability(g[1:])

    return probability


def test_one_model_equals_the_definition():
    texts = ["abc abd abc", "bca bcb dda"]
    s, _ = L.symbols(texts)
    models = L.Models({"aa": np.unique(L.grams(s)[s != 0], return_counts=True)})
    p = kneser_ney(texts, L.ORDER)
    for text in ["abc bcd", "zzz", "d"]:
        s = [0] * (L.ORDER - 1) + [ord(c) for c in text]
        want = -sum(math.log(p(tuple(s[i - L.ORDER + 1 : i + 1]))) for i in range(L.ORDER - 1, len(s))) / len(text)
        assert models.entropies([text])[0][0, 0] == pytest.approx(want, rel=1e-4)


def test_language_held_out_and_odd_rows(spark):
    from pixelstrata.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = QUERIES["op10_language_id"](spark, sf).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(out) == docs.count() and (out[out["held_out"]]["lang_pred"] == out[out["held_out"]]["lang"]).mean() > 0.97
    more = [(-1, None, "en"), (-2, "", "en"), (-3, "123 !!", None), (-3, "123 !!", None), (None, "the", "en"), (-4, "Ελληνικά και άλλα γράμματα " * 20, None)]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    odd = defaultdict(list)
    for r in L.languages(both).where("doc_id < 0 or doc_id is null").collect():
        odd[r.doc_id].append(r)
    assert {r.lang_pred for k in (-1, -2, -3) for r in odd[k]} == {"und"} and len(odd[-3]) == 2
    assert all(r.rejected and r.score == 0 for k in (-1, -2, -3) for r in odd[k])
    assert odd[-4][0].lang_pred in ("en", "de", "es", "fr") and odd[-4][0].rejected
    kept = L.keep_identified(both.withColumn("score", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.where("doc_id in (-1, -2, -3, -4)").count() == 0
    assert kept.where("doc_id >= 0").count() == docs.count()


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.languages(df).collect()] == ["und"]
    assert L.languages(df.limit(0)).count() == 0


def test_capacity_bounds_the_model(spark):
    df = spark.createDataFrame([("a", "abcdefgh" * 3 + "xyz"), ("b", "hgfedcba" * 3)], "lang string, text string")
    small = L.fit(df, capacity=20)
    assert sum(len(x.hashes) for x in small.probability[L.ORDER :]) <= 20 and small.langs == ["a", "b"]


def test_beyond_capacity_no_gram_is_dropped(spark):
    more = [("cjk", "".join(chr(0x4E00 + (7 * k * k + 3 * k) % 900) for k in range(60)))]
    train = spark.createDataFrame([("a", "abcdefgh abd rare " * 3 + "xyz"), ("b", "hgfedcba, once only"), *more], "lang string, text string")
    texts = ["abcdefgh xyz", "hgfedcba", "once", "zzz", more[0][1][:9], "12 !", "", None, "abcdefgh xyz", "\u4e00 ab \ud7ff"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small, whole = L.fit(train, capacity=20), L.fit(train)
    assert len(whole.probability[L.ORDER].hashes) > 20
    out = [sorted(L._scored(docs, m).collect()) for m in (small, whole)]
    assert len(out[0]) == len(texts)
    for a, b in zip(*out):
        assert (a.doc_id, a._lang, a._letters) == (b.doc_id, b._lang, b._letters)
        assert a._entropy == pytest.approx(b._entropy, rel=1e-5) and a._score == pytest.approx(b._score, rel=1e-4)


def test_language_by_table_on_whole_tables(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r for r in L.languages(docs).collect()}
    fit = L.fit
    monkeypatch.setattr(L, "fit", lambda training: fit(training, capacity=1000))
    got = L.languages(docs).collect()
    assert len(got) == docs.count() and all((r.lang_pred, r.rejected) == (want[r.doc_id].lang_pred, want[r.doc_id].rejected) for r in got)
    assert all(r.score == pytest.approx(want[r.doc_id].score, abs=1e-3) for r in got)
