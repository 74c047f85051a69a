"""Exact quantiles vs numpy, IQR gates, KNN imputation vs a brute-force reference."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazecast.operators.filters import iqr_filter
from hazecast.operators.knn import knn_impute
from hazecast.operators.quantiles import exact_quantiles


def test_exact_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for k, n in [("a", 1), ("b", 2), ("c", 537), ("d", 2000)]:
        vals = np.round(rnd.gamma(2.0, 30.0, n), 3)
        if k == "d":
            vals[:500] = 42.0  # heavy ties
        rows += [(k, float(v)) for v in vals]
    df = spark.createDataFrame(rows, "k string, x double")
    q = exact_quantiles(df, ["k"], "x", [0.25, 0.5, 0.75, 0.1], ["q25", "q50", "q75", "q10"]).collect()
    for r in q:
        xs = np.array([v for kk, v in rows if kk == r["k"]])
        for p, name in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.1, "q10")]:
            assert r[name] == np.percentile(xs, p * 100), (r["k"], name)


def test_exact_quantiles_of_tied_columns(spark):
    """A 0/1 column and one with 90 % ties: equal values are counted, not sorted one by one."""
    df = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("other").alias("k"),
        (F.col("id") % 7 == 0).cast("double").alias("bit"),
        F.when(F.col("id") % 10 != 0, 5.0).otherwise(F.col("id") / 7).alias("tied"))
    pdf = df.toPandas()
    for col in ("bit", "tied"):
        for r in exact_quantiles(df, ["k"], col, [0.0, 0.5, 0.9, 0.95, 1.0], ["a", "b", "c", "d", "e"]).collect():
            xs = pdf[pdf["k"] == r["k"]][col].to_numpy()
            assert [r[n] for n in "abcde"] == pytest.approx(np.percentile(xs, [0, 50, 90, 95, 100]).tolist(), rel=1e-12)
    from hazecast.operators.quantiles import ranked_slices
    assert ranked_slices(df.select("k", F.col("bit").alias("_x")), ["k"]).count() == 4  # all that is sorted


def test_iqr_gate_and_nulls(spark):
    base = [float(i) for i in range(20)] + [1000.0]
    rows20 = [("g20", v) for v in base[:19]] + [("g20", 1000.0)]  # 20 values: gate closed
    rows21 = [("g21", v) for v in base] + [("g21", None)]  # 21 values: gate open, null dropped
    df = spark.createDataFrame(rows20 + rows21, "city string, aqi double")
    out = iqr_filter(df, ["city"], "aqi", k=3)
    got = {c: n for c, n in out.groupBy("city").count().collect()}
    assert got["g20"] == 20
    assert got["g21"] == 20  # 1000 outside the fence, null dropped
    keep = iqr_filter(df, ["city"], "aqi", k=3, nulls="keep").groupBy("city").count().collect()
    assert {c: n for c, n in keep}["g21"] == 21


def _brute_knn(rows, cols, k=5):
    """Published definition: nan-Euclidean distance, uniform mean of the k nearest donors with the value."""
    X = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], dtype=float)
    ts = [r[0] for r in rows]
    out = X.copy()
    means = np.nanmean(X, axis=0)
    for i in range(len(rows)):
        for j in range(len(cols)):
            if not np.isnan(X[i, j]):
                continue
            cand = []
            for d in range(len(rows)):
                if np.isnan(X[d, j]):
                    continue
                both = ~np.isnan(X[i]) & ~np.isnan(X[d])
                if both.sum() == 0:
                    continue
                dist = len(cols) / both.sum() * np.sum((X[i, both] - X[d, both]) ** 2)
                cand.append((dist, ts[d], X[d, j]))
            cand.sort()
            out[i, j] = np.mean([c[2] for c in cand[:k]]) if cand else means[j]
    return out


def test_knn_matches_brute_force(spark):
    rnd = random.Random(11)
    cols = ["a", "b", "c"]
    rows = []
    t = dt.datetime(2024, 1, 1)
    for i in range(120):
        vals = [None if rnd.random() < 0.2 else float(rnd.randint(0, 20)) for _ in cols]  # many equal distances
        rows.append((t + dt.timedelta(hours=i), *vals))
    rows.append((t + dt.timedelta(hours=500), 3.0, None, None))  # only 'a' present
    rows.append((t + dt.timedelta(hours=501), None, None, 7.0))
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, a double, b double, c double").withColumn("city", F.lit("x"))
    got = knn_impute(df, ["city"], "timestamp", cols, k=5).orderBy("timestamp").toPandas()
    exp = _brute_knn(rows, cols)
    assert np.allclose(got[cols].to_numpy(dtype=float), exp, rtol=0, atol=1e-9, equal_nan=True)


def test_knn_no_shared_coordinate_gets_mean(spark):
    rows = [(dt.datetime(2024, 1, 1, h), float(h), None) for h in range(6)] + [(dt.datetime(2024, 1, 2), None, 5.0)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, a double, b double").withColumn("city", F.lit("x"))
    got = knn_impute(df, ["city"], "timestamp", ["a", "b"], k=5).orderBy("timestamp").collect()
    assert got[-1]["a"] == sum(range(6)) / 6  # no donor shares a coordinate -> column mean
    assert got[0]["b"] == 5.0  # b: receivers use the one donor that shares... none; mean of b = 5.0


def test_knn_many_tiles_equal_one(spark):
    """Receivers and donors dealt over many tiles give the same result as one tile pair."""
    rnd = random.Random(5)
    cols = ["a", "b", "c"]
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(hours=i), *[None if rnd.random() < 0.25 else float(rnd.randint(0, 50)) for _ in cols])
            for i in range(200)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, a double, b double, c double") \
        .withColumn("city", F.when(F.col("a") > 25, "p").otherwise("q"))
    one = knn_impute(df, ["city"], "timestamp", cols, k=5).orderBy("timestamp").toPandas()
    many = knn_impute(df, ["city"], "timestamp", cols, k=5, receiver_tile=9, donor_tile=17).orderBy("timestamp").toPandas()
    assert np.array_equal(one[cols].to_numpy(dtype=float), many[cols].to_numpy(dtype=float), equal_nan=True)


@pytest.mark.parametrize("accuracy,collected", [(10_000, 200_000), (50, 200_000), (50, 10), (100, 0)])
def test_wide_quantiles_are_exact(spark, accuracy, collected):
    """Ties, constants, nulls, NaN, few rows, with and without bounds, ranks found in Spark or here."""
    from hazecast.operators.quantiles import wide_quantiles
    rng = np.random.default_rng(3)
    n = 3_000
    cols = {"a": rng.normal(size=n), "b": rng.integers(0, 2, n).astype(float), "c": np.full(n, 7.5), "d": np.round(rng.normal(size=n), 1),
            "e": np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n)), "f": np.where(np.arange(n) < 3, 1.0 * np.arange(n), np.nan),
            "g": np.full(n, np.nan), "h": np.where(rng.random(n) < 0.5, 0.0, rng.exponential(size=n))}
    rows = [tuple(None if k == "h" and i % 7 == 0 else float(v[i]) for k, v in cols.items()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in cols)).repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = wide_quantiles(df, list(cols), probs, accuracy, collected)
    for k, v in cols.items():
        v = v[[i for i in range(n) if not (k == "h" and i % 7 == 0)]]
        v = v[~np.isnan(v)]
        assert got[k][0] == len(v)
        if len(v):
            assert np.allclose(got[k][1], np.quantile(v, probs), rtol=1e-13, atol=0), k
        else:
            assert got[k][1] == [None] * len(probs)


def test_wide_quantiles_of_no_rows(spark):
    from hazecast.operators.quantiles import wide_quantiles
    assert wide_quantiles(spark.createDataFrame([], "a double, b int"), ["a", "b"], [0.5]) == {"a": (0, [None]), "b": (0, [None])}
