"""Ordering, resampling and numeric helpers against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelstrata.functions.ordering import average_rank, bounded_quantiles, exact_quantiles, first_n, ordinal_within, with_halo
from pixelstrata.functions.resampling import bootstrap_means, paired
from pixelstrata.functions.scalars import corr_agg, flag_list, psnr_from_mse, reflect, rnd, safe_div


def hot(spark, n=3000, seed=1):
    """Two thirds of the rows share one key and many values repeat."""
    r = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": np.where(r.random(n) < 0.66, 0, r.integers(1, 6, n)), "v": np.round(r.normal(0, 10, n), 1), "i": np.arange(n)})
    pdf.loc[r.random(n) < 0.3, "v"] = 1.0
    return pdf, spark.createDataFrame(pdf)


def test_ordinal_within_equals_row_number(spark):
    pdf, df = hot(spark)
    got = ordinal_within(df, "k", ["v", "i"], F.floor("v"), "pos").toPandas().sort_values("i")
    want = pdf.sort_values(["v", "i"]).groupby("k").cumcount().add(1).sort_index()
    assert (got["pos"].to_numpy() == want.to_numpy()).all()


def test_halo_windows_equal_plain_windows(spark):
    df = spark.range(1, 301).select(F.lit("a").alias("f"), F.col("id").alias("frame"), (F.col("id") * 7 % 31).alias("v"))
    w = W.partitionBy("f").orderBy("frame").rowsBetween(-4, 2)
    want = {r[0]: r[1] for r in df.select("frame", F.sum("v").over(w)).collect()}
    h = with_halo(df, "frame", 16, before=4, after=2)
    wc = W.partitionBy("f", "_chunk").orderBy("frame").rowsBetween(-4, 2)
    got = {r[0]: r[1] for r in h.select("frame", "_core", F.sum("v").over(wc).alias("s")).where("_core").select("frame", "s").collect()}
    assert got == want


@pytest.mark.parametrize("bins", [1, 3, 2048])
def test_exact_quantiles(spark, bins):
    pdf, df = hot(spark)
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.977, "e": 1.0}
    for r in exact_quantiles(df, "k", "v", probs, accuracy=bins).collect():
        v = pdf.loc[pdf.k == r["k"], "v"]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(v, p), abs=1e-9)
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).collect()[0]["m"]
    assert whole == pytest.approx(np.median(pdf.v))


def test_exact_quantiles_with_an_outlier_and_a_hot_key(spark):
    df = spark.range(1_000_000).selectExpr("CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS k", "CASE WHEN id = 1 THEN 1e9 ELSE pmod(hash(id), 100003) / 7.0D END AS v")
    p = df.toPandas()
    for r in exact_quantiles(df, "k", "v", {"q1": 0.01, "m": 0.5, "q99": 0.999, "top": 1.0}).collect():
        want = np.quantile(p[p.k == r.k].v, [0.01, 0.5, 0.999, 1.0])
        assert np.allclose([r.q1, r.m, r.q99, r.top], want, rtol=1e-12)


def test_bounded_quantiles(spark):
    pdf, df = hot(spark, 500)
    for r in bounded_quantiles(df, "k", "v", {"m": 0.5, "q": 0.9}).collect():
        v = pdf.loc[pdf.k == r["k"], "v"]
        assert r["m"] == pytest.approx(np.median(v)) and r["q"] == pytest.approx(np.quantile(v, 0.9))


def test_average_rank_ties(spark):
    df = spark.createDataFrame([(5.0,), (1.0,), (5.0,), (7.0,)], "v double")
    assert sorted((r.v, r.k) for r in average_rank(df, [], "v", "k").collect()) == [(1.0, 1.0), (5.0, 2.5), (5.0, 2.5), (7.0, 4.0)]


def test_safe_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    assert df.agg(corr_agg("a", "b")).collect()[0][0] is None


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("inf"), 2.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, None, 1.5]
    one = spark.range(1)
    assert one.select(psnr_from_mse(F.lit(0.0), 1.0)).collect()[0][0] == float("inf")
    assert one.select(psnr_from_mse(F.lit(0.01), 1.0)).collect()[0][0] == pytest.approx(20.0)
    assert one.select(flag_list(("b", F.lit(True)), ("a", F.lit(True)), ("c", F.lit(False)), ("b", F.lit(True)))).collect()[0][0] == "a;b"
    assert [one.select(reflect(F.lit(i), 4)).collect()[0][0] for i in (-2, -1, 0, 3, 4, 5)] == [1, 0, 0, 3, 3, 2]
    assert one.select(rnd(F.lit(0.03125), 4)).collect()[0][0] == 0.0313


def test_paired(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "k int")
    assert paired(df, "k", unordered=True).count() == 15
    assert paired(df, "k", unordered=False).count() == 30
    assert all(r.a.k < r.b.k for r in paired(df, "k", unordered=True).collect())


def test_bootstrap_is_reproducible_and_centred(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(10)], "g string, u int, v double")
    a = [r.mean for r in bootstrap_means(df, ["g"], "u", "v", 400, 3).orderBy("b").collect()]
    b = [r.mean for r in bootstrap_means(df.repartition(5), ["g"], "u", "v", 400, 3).orderBy("b").collect()]
    assert a == b and abs(np.mean(a) - 4.5) < 0.2 and 0.6 < np.std(a) < 1.2


def test_first_n(spark):
    pdf, df = hot(spark, 300)
    assert first_n(df, "k", ["v", "i"], 2).groupBy("k").count().agg(F.max("count")).collect()[0][0] == 2


def test_natural_order_of_any_digits_in_many_tasks(spark):
    from pixelstrata.functions.ordering import range_ordinals
    from pixelstrata.operators.ranking import natural_order

    names = ["10.tif", "2.tif", "002.tif", "x9", "a", "12345678901234567890.tif", "12345678901234567891.tif", "9" * 30, "0", "", None]
    d = spark.createDataFrame([(g, n) for g in (1, 2) for n in names], "g int, name string")
    for g in (1, 2):
        got = [r.name for r in natural_order(d.where(F.col("g") == g).repartition(5), "g", "name").orderBy("position").collect()]
        assert [n for n in got if n is not None] == ["0", "002.tif", "2.tif", "10.tif", "12345678901234567890.tif", "12345678901234567891.tif", "9" * 30, "", "a", "x9"]
    many = spark.range(60_000).select(F.lit("one").alias("g"), F.concat(F.lit("img_"), F.col("id").cast("string")).alias("name"), F.lit(7).alias("n"))
    o = range_ordinals(many, "g", ["n", "name"], "p")
    assert o.agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()[:] == (60_000, 1, 60_000)
    want = sorted(f"img_{k}" for k in range(60_000))
    assert [r.name for r in o.where("p % 10007 = 1").orderBy("p").collect()] == want[::10007]
    tied = range_ordinals(spark.createDataFrame([(None, 1), (None, 1), (3, 1)], "g int, v int"), "g", ["v"], "p")
    assert sorted(((r.g or 0), r.p) for r in tied.collect()) == [(0, 1), (0, 2), (3, 1)]
