"""Weather codes of two vocabularies, the plain floor, display defaults, a store that breaks while it is read, model bands."""

import datetime as dt
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazecast.functions import weather as wx
from hazecast.plans.scoring import floor_zero
from hazecast.session import scratch_path
from hazecast.sources import payloads as S

T0 = dt.datetime(2024, 1, 1)


def test_codes_of_both_vocabularies_meet(spark):
    rows = [("archive", 0), ("archive", 63), ("archive", 4), ("archive", None), ("current", 800), ("current", 501), ("forecast3h", 601),
            ("forecast3h", 999), ("current", 63), ("current", 211), ("archive", 95)]
    df = spark.createDataFrame([(i, s, c, 36.0, 3.0) for i, (s, c) in enumerate(rows)], "i int, src string, weather_code int, wind_speed double, precipitation double")
    got = {r.i: (r.weather_group, r.weather_code) for r in wx.normalise_units(df, F.col("src")).collect()}
    assert got == {0: ("Clear", 0), 1: ("Rain", 63), 2: (None, 4), 3: (None, None), 4: ("Clear", 0), 5: ("Rain", 61), 6: ("Snow", 71), 7: (None, None),
                   8: (None, None), 9: ("Thunderstorm", 95), 10: ("Thunderstorm", 95)}
    assert {name for *_, name in wx.WMO_GROUPS} == {name for *_, name in wx.CONDITION_GROUPS} == set(wx.GROUP_CODE)
    assert all(any(a <= wx.GROUP_CODE[g] <= b for a, b, name in wx.WMO_GROUPS if name == g) for g in wx.GROUP_CODE)


def test_floor_and_display_defaults(spark):
    df = spark.createDataFrame([(-3.0, None, 5.0), (None, 21.0, None)], "p double, temp double, feels_like double")
    got = wx.apply_display_defaults(df).select(floor_zero(F.col("p")), "temp", "feels_like").collect()
    assert [tuple(r) for r in got] == [(0.0, 25.0, 5.0), (None, 21.0, 21.0)]


def test_a_store_that_breaks_while_it_is_read(spark):
    path, csv = scratch_path(spark, "v-store"), scratch_path(spark, "v-csv")
    rng = np.random.default_rng(0)
    good = spark.createDataFrame([("c", T0 + dt.timedelta(hours=i), float(v)) for i, v in enumerate(rng.normal(size=5_000))],
                                 "city string, timestamp timestamp_ntz, aqi double").coalesce(1)
    good.write.parquet(path)
    good.limit(7).write.option("header", True).csv(csv)
    file = glob.glob(f"{path.removeprefix('file:')}/part-*")[0]
    with open(file, "r+b") as f:  # the footer stays, so the store resolves
        f.seek(2_000)
        f.write(b"\xff" * 6_000)
    backup = lambda: spark.read.option("header", True).schema(good.schema).csv(csv)
    lazy = S.read_with_fallback(lambda: S.read_store(spark, path), backup)
    with pytest.raises(Exception):
        lazy.agg(F.sum("aqi"), F.max("timestamp")).collect()
    with pytest.warns(UserWarning, match="falling back"):
        got = S.read_with_fallback(lambda: S.read_store(spark, path), backup, read_through=True)
    assert got.count() == 7
    whole = scratch_path(spark, "v-whole")
    good.write.parquet(whole)
    assert S.read_with_fallback(lambda: S.read_store(spark, whole), backup, read_through=True).count() == 5_000


@pytest.mark.parametrize("name,rmse,r2", [("Random Forest", 6.5, 0.85), ("Gradient Boosting", 6.0, 0.85), ("Boosted Variant", 6.0, 0.85),
                                          ("Huber Regression", 8.0, 0.75)])
def test_models_reach_their_band(spark, monkeypatch, name, rmse, r2):
    """A smooth target with noise of deviation 2, for the robust model with a few gross errors in training; fewer
    rounds than in service."""
    from hazecast.models import train as M
    monkeypatch.setattr(M, "RF_PARAMS", {**M.RF_PARAMS, "numTrees": 40})
    monkeypatch.setattr(M, "GBT_PARAMS", {**M.GBT_PARAMS, "maxIter": 40, "stepSize": 0.15})
    monkeypatch.setattr(M, "BOOSTED_VARIANT_PARAMS", {**M.BOOSTED_VARIANT_PARAMS, "maxIter": 30, "stepSize": 0.15})
    rng, robust = np.random.default_rng(8), name == "Huber Regression"
    cols = ["temp", "humidity", "wind_speed", "precipitation"]
    rows = []
    for i in range(1_200):
        v = rng.normal(size=4)
        y = 60 + 12 * v[0] - 8 * v[1] + (6 if v[2] > 0 else -2) + rng.normal(scale=2.0) + (150 if robust and i % 97 == 0 and i < 900 else 0)
        rows.append(("c", T0 + dt.timedelta(hours=i), *[None if rng.random() < 0.02 else float(x) for x in v], float(y)))
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in cols) + ", aqi double")
    cut = F.lit(T0 + dt.timedelta(hours=900))
    trained = M.train_models(df.where(F.col("timestamp") < cut), df.where(F.col("timestamp") >= cut), cols, names=[name])
    got = M.results_of(trained).first()
    assert got.model == name and got.rmse < rmse and got.r2 > r2, got
