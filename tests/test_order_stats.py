"""The skew-proof order statistics against numpy / pandas brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plinth.operators import order_stats as O
from plinth.operators.topk import thin_by_quota, thin_systematic


def frame(seed=7):
    rng = np.random.default_rng(seed)
    n = 3000
    group = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    x = np.where(rng.random(n) < 0.3, 100.0, rng.lognormal(3, 2, n) * rng.choice([-1, 1], n, p=[.1, .9]))
    x[rng.random(n) < 0.02] = 0.0
    return pd.DataFrame({"g": group, "x": x, "y": rng.integers(0, 9, n).astype(float)})


def test_quantiles_match_pandas(spark):
    pdf = frame()
    out = O.quantiles(spark.createDataFrame(pdf), ["g"], {"x": {"p10": .1, "med": .5, "p99": .99}, "y": {"ymed": .5}}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert out.loc[g, "p10"] == pytest.approx(part.x.quantile(.1), rel=1e-12)
        assert out.loc[g, "med"] == pytest.approx(part.x.median(), rel=1e-12)
        assert out.loc[g, "p99"] == pytest.approx(part.x.quantile(.99), rel=1e-12)
        assert out.loc[g, "ymed"] == part.y.median()


def test_quantiles_null_key_nan_and_infinity(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", float("nan")), ("a", float("inf")), ("a", 5.0), ("b", None)], "g string, x double")
    out = {r.g: r.m for r in O.quantiles(df, ["g"], {"x": {"m": .5}}).collect()}
    assert out == {None: 2.0, "a": 5.0}


def test_average_ranks_and_spearman(spark):
    pdf = frame(3)
    df = spark.createDataFrame(pdf)
    ranks = {r.y: r.avg_rank for r in O.average_ranks(df, "y").collect()}
    expected = pdf.assign(r=pdf.y.rank()).groupby("y").r.first().to_dict()
    assert ranks == expected
    row = O.spearman(df, "x", "y").first()
    assert row.rho == pytest.approx(pdf.x.rank().corr(pdf.y.rank()), abs=1e-12) and row.pairs == len(pdf)


def test_numbered_is_a_dense_row_number_despite_a_hot_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).cast("double").alias("k"), F.col("id").cast("double").alias("t"))
    rows = O.numbered(df, "k", ["t"]).orderBy("row_no").collect()
    assert [r.row_no for r in rows] == list(range(1, 5001))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_thinning_keeps_every_kth_row(spark):
    kept = thin_systematic(spark.range(1000).select(F.col("id").cast("double").alias("k")), "k", 100)
    assert sorted(r.k for r in kept.collect()) == [float(i) for i in range(0, 1000, 10)]


def test_keep_first_collapses_copies(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "z"), (1, 1, "a"), (2, 9, "q")], "id int, o int, v string")
    assert sorted(tuple(r) for r in O.keep_first(df, ["id"], ["o"]).collect()) == [(1, 1, "a"), (2, 9, "q")]


def test_ranges_hold_neither_close_values_nor_one_value_nor_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "PART_ROWS", 1000)
    close = spark.range(2**60, 2**60 + 9000).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    for df in (close, close.withColumn("k", F.lit(5)).withColumn("t", F.col("k").cast("string")), close.select(F.lit(1).alias("k"), F.lit("x").alias("t"))):
        sizes = [r["count"] for r in O.in_ranges(df, ["k"]).groupBy("__part").count().collect()]
        assert sum(sizes) == 9000 and max(sizes) < 2000
        assert sorted(r.row_no for r in O.numbered(df, "k").collect()) == list(range(1, 9001))
    assert O.numbered(close, "k").where("row_no != k - 1152921504606846975").isEmpty()
    ranks = O.average_ranks(close, "k")
    assert ranks.where("avg_rank != k - 1152921504606846975").isEmpty() and ranks.count() == 9000


def test_numbering_within_keys_by_text_with_nulls_and_clashing_names(spark):
    rows = [("a", "z", 1), ("a", None, 2), (None, "q", 3), ("a", "b", 4), (None, "p", 5), ("b", "x", 6)]
    df = spark.createDataFrame(rows, "g string, `v.w` string, id int").withColumnRenamed("v.w", "v")
    found = {r.id: r.row_no for r in O.numbered(df, "v", keys=["g"]).collect()}
    assert found == {1: 3, 2: 1, 3: 2, 4: 2, 5: 1, 6: 1}
    assert O.numbered(df.limit(0), "v", keys=["g"]).isEmpty() and O.average_ranks(df.limit(0), "id", ["g"]).isEmpty()


def test_quotas_are_met_exactly_and_unknown_files_stay_whole(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").when(F.col("id") < 990, "small").otherwise("new").alias("f"))
    quotas = spark.createDataFrame([("big", 900, 70), ("small", None, 200)], "file string, rows long, quota long")
    kept = thin_by_quota(df, "f", "id", quotas)
    assert {r.f: r["count"] for r in kept.groupBy("f").count().collect()} == {"big": 70, "small": 90, "new": 10}
    ids = sorted(r.id for r in kept.where("f = 'big'").collect())
    assert ids[-1] == 899 and {b - a for a, b in zip(ids, ids[1:])} <= {12, 13}
