"""Upsert idempotence and order-freedom, staged deletes, reload gate, TreeSHAP additivity, splits."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazecast.session import scratch_path
from hazecast.sinks import files as K


def _rows(spark, n, seq0=0, bump=0.0):
    rows = [("c", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i) + bump, seq0 + i, (i // 24) + 1)
            for i in range(n)]
    return spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, aqi double, ingest_seq long, day int")


def test_upsert_last_write_wins_and_idempotent(spark):
    target = scratch_path(spark, "t-upsert")
    K.write_table(_rows(spark, 72), target, ["city", "day"])
    batch = _rows(spark, 24, seq0=1000, bump=0.5).unionByName(_rows(spark, 24, seq0=2000, bump=0.25))
    a = K.upsert(spark, target, batch, ["city", "timestamp"], "ingest_seq", ["city", "day"])
    first = sorted(map(tuple, a.select("timestamp", "aqi").collect()))  # the result reads the live table
    got = dict(first)
    assert len(got) == 72 and got[dt.datetime(2024, 1, 1, 5)] == 5.25 and got[dt.datetime(2024, 1, 2, 5)] == 29.0
    # replaying the same batch in another order changes nothing
    b = K.upsert(spark, target, batch.orderBy(F.rand(1)), ["city", "timestamp"], "ingest_seq", ["city", "day"])
    assert first == sorted(map(tuple, b.select("timestamp", "aqi").collect()))


def test_delete_and_batched_write(spark):
    path = scratch_path(spark, "t-delete")
    K.write_table(_rows(spark, 72), path, ["city", "day"])
    out = K.delete_where(spark, path, F.col("timestamp") < F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"),
                         ["city", "day"])
    assert out.count() == 48
    counts = K.batched_write(_rows(spark, 250), scratch_path(spark, "t-batched"), 100).first()
    assert counts["rows"] == 250 and counts["batches"] == 3


def test_reload_rejects_nothing_when_clean(spark):
    from hazecast.sources.bindings import params_hourly, weather_hourly
    from hazecast.plans.history import build_history
    s = build_history(weather_hourly(spark, "/root/testdata/sf0.001"), params_hourly(spark, "/root/testdata/sf0.001"))
    csv = scratch_path(spark, "t-reload-csv")
    s.write.mode("overwrite").option("header", True).csv(csv)
    out = K.reload_table(spark, csv, scratch_path(spark, "t-reload"))
    assert out.count() == s.count()


def test_treeshap_additivity(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    from hazecast.models.importance import contributions
    rnd = np.random.default_rng(0)
    X = rnd.normal(size=(300, 4))
    y = 3 * X[:, 0] - 2 * X[:, 1] * (X[:, 2] > 0) + rnd.normal(scale=0.1, size=300)
    df = spark.createDataFrame([(i, *map(float, x), float(t)) for i, (x, t) in enumerate(zip(X, y))],
                               "id long, a double, b double, c double, d double, label double")
    va = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)
    for est in (RandomForestRegressor(numTrees=7, maxDepth=5, seed=1), GBTRegressor(maxIter=6, maxDepth=3, seed=1)):
        m = est.fit(va)
        pred = {r["id"]: r["prediction"] for r in m.transform(va).select("id", "prediction").collect()}
        c = contributions(df.limit(40), m, ["a", "b", "c", "d"], ["id"]).collect()
        for r in c:
            assert abs(sum(r["contrib"]) + r["base"] - pred[r["id"]]) < 1e-6
            assert abs(r["tree_sum"] - pred[r["id"]]) < 1e-9


def test_chronological_split(spark):
    from hazecast.models.prep import chronological_split, tail_validation_split
    df = _rows(spark, 101)
    tr, te = chronological_split(df, 0.8)
    assert tr.count() == 80 and te.count() == 21
    assert tr.agg(F.max("timestamp")).first()[0] < te.agg(F.min("timestamp")).first()[0]
    fit, val = tail_validation_split(tr, 0.2)
    assert fit.count() == 64 and val.count() == 16


def test_saved_model_serves_raw_features(spark):
    """Save, load, score: the same predictions, with imputation and scaling inside, and the
    weather columns as they came."""
    from hazecast.models.train import load_best_model, results_of, save_registry, train_models
    from hazecast.plans.scoring import score_forecast
    rnd = np.random.default_rng(4)
    cols = ["temp", "humidity", "wind_speed", "precipitation"]
    rows = [("c", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), *[None if rnd.random() < 0.1 else float(x) for x in v], float(50 + 5 * v[0] - 2 * v[1] + rnd.normal()))
            for i, v in enumerate(rnd.normal(size=(400, 4)))]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, temp double, humidity double, wind_speed double, precipitation double, aqi double")
    cut = dt.datetime(2024, 1, 13)
    train, test = df.filter(F.col("timestamp") < F.lit(cut)), df.filter(F.col("timestamp") >= F.lit(cut))
    trained = train_models(train, test, cols, names=["Huber Regression"])
    res = results_of(trained)
    assert res.first()["rmse"] < 4 and res.first()["r2"] > 0.6
    path = scratch_path(spark, "t-served")
    assert save_registry(spark, path, trained, res, cols, train.count()) == "Huber Regression"
    ahead = test.withColumns({"current_aqi": F.lit(50.0), "hour": F.hour("timestamp")})
    got = score_forecast(load_best_model(path), ahead).orderBy("timestamp").collect()
    own = score_forecast(trained[0].model, ahead).orderBy("timestamp").collect()
    assert got == own and len(got) == test.count()
    assert [r["temp"] for r in got] == [r["temp"] for r in test.orderBy("timestamp").collect()]


def test_training_rows_are_dealt_over_tasks(spark, monkeypatch):
    """Tens of thousands of rows are no single task; the number of tasks goes by the rows alone."""
    from hazecast.models import train as M
    assert [M.train_partitions(n) for n in (0, 1, 16_384, 34_310, 205_860)] == [1, 1, 1, 3, 13]
    assert M.train_partitions(5_000_000) == 64 and M.train_partitions(40_000_000) == 200
    monkeypatch.setitem(M.RF_PARAMS, "numTrees", 3)
    monkeypatch.setitem(M.RF_PARAMS, "maxDepth", 3)
    monkeypatch.setitem(M.GBT_PARAMS, "maxIter", 2)
    seen = {}
    for cls in (M.RandomForestRegressor, M.GBTRegressor):
        def fit(self, df, params=None, own=cls.fit, name=cls.__name__):
            seen[name] = df.rdd.getNumPartitions()
            return own(self, df, params)
        monkeypatch.setattr(cls, "fit", fit)
    n = 40_000
    df = spark.range(n).select(F.lit("c").alias("city"), F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"),
                               (F.col("id") % 24).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                               (F.col("id") % 24 * 2 + F.col("id") % 7).cast("double").alias("aqi"))
    trained = M.train_models(df, df.limit(100), ["a", "b"], names=["Random Forest", "Gradient Boosting"])
    assert seen == {"RandomForestRegressor": 3, "GBTRegressor": 2}
    assert [t.predictions.where("prediction is not null").count() for t in trained] == [100, 100]
