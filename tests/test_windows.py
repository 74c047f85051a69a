"""Halo and carry plans equal the single-window results (gaps, nulls, many keys, tiny blocks)."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazecast.operators.joins import asof_value, range_mean
from hazecast.operators.windows import fill_forward_backward, series_row_features


def _series(spark, n=700, keys=3, seed=7, null_share=0.2):
    rnd = random.Random(seed)
    rows = []
    for k in range(keys):
        t = dt.datetime(2024, 1, 1)
        for i in range(n - 100 * k):
            t += dt.timedelta(hours=rnd.choice([1, 1, 1, 2, 5]))
            v = None if rnd.random() < null_share else float(rnd.randint(0, 300))
            rows.append((f"c{k}", t, v))
    return spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, aqi double")


@pytest.mark.parametrize("block", [97, 128, 300])
def test_halo_equals_plain(spark, block):
    df = _series(spark)
    kw = dict(lags=(72, 96), rolls=(72, 96), min_periods=24, change_rate="chg")
    a = series_row_features(df, ["city"], "timestamp", ["timestamp"], "aqi", block_rows=block, **kw)
    b = series_row_features(df, ["city"], "timestamp", ["timestamp"], "aqi", method="plain", **kw)
    cols = ["city", "timestamp", "aqi_lag_72h", "aqi_lag_96h", "aqi_rolling_72h", "aqi_rolling_96h", "chg"]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
    assert a.count() == b.count() == df.count()


def test_rolling_warmup_and_exclusion(spark):
    rows = [("c", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, aqi double")
    out = series_row_features(df, ["city"], "timestamp", ["timestamp"], "aqi", rolls=(72,), block_rows=50)
    got = {r["aqi"]: r["aqi_rolling_72h"] for r in out.collect()}
    assert got[22.0] is None and got[23.0] == sum(range(24)) / 24
    assert got[71.0] == sum(range(72)) / 72 and got[72.0] == sum(range(1, 73)) / 72
    prior = series_row_features(df, ["city"], "timestamp", ["timestamp"], "aqi", rolls=(72,), include_current=False,
                                block_rows=50)
    got2 = {r["aqi"]: r["aqi_rolling_72h"] for r in prior.collect()}
    assert got2[24.0] == sum(range(24)) / 24 and got2[23.0] is None


def test_fill_forward_backward_matches_pandas(spark):
    df = _series(spark, n=300, null_share=0.5)
    out = fill_forward_backward(df, ["city"], "timestamp", ["timestamp"], ["aqi"], unit="day").toPandas()
    pdf = df.toPandas().sort_values(["city", "timestamp"])
    pdf["exp"] = pdf.groupby("city")["aqi"].transform(lambda s: s.ffill().bfill())
    m = pdf.merge(out, on=["city", "timestamp"], suffixes=("_in", ""))
    assert (m["exp"].fillna(-1) == m["aqi"].fillna(-1)).all()


def _brute_asof(hist, probes, h):
    out = {}
    for (c, t) in probes:
        cand = [(ts, v) for (cc, ts, v) in hist if cc == c and ts <= t - dt.timedelta(hours=h)]
        out[(c, t)] = ("hit", max(cand)[1]) if cand else ("miss", None)
    return out


def test_asof_and_range_against_brute_force(spark):
    base = dt.datetime(2024, 1, 10)
    hist = [("c", base - dt.timedelta(hours=72), 5.0), ("c", base - dt.timedelta(hours=1), None),
            ("c", base - dt.timedelta(hours=30), 7.0), ("c", base - dt.timedelta(hours=80), 9.0),
            ("d", base + dt.timedelta(hours=3), 1.0)]
    probes = [("c", base), ("c", base - dt.timedelta(hours=20)), ("c", base + dt.timedelta(hours=1)),
              ("d", base), ("c", base - dt.timedelta(hours=200))]
    H = spark.createDataFrame(hist, "city string, timestamp timestamp_ntz, aqi double")
    P = spark.createDataFrame(probes, "city string, timestamp timestamp_ntz")
    got = {(r["city"], r["timestamp"]): r["lag"] for r in
           asof_value(P, H, ["city"], "timestamp", "timestamp", "aqi", 72, F.lit(-1.0), "lag").collect()}
    exp = _brute_asof(hist, probes, 72)
    for k, (kind, v) in exp.items():
        assert got[k] == (v if kind == "hit" else -1.0)
    rm = {(r["city"], r["timestamp"]): r["m"] for r in
          range_mean(P, H, ["city"], "timestamp", "timestamp", "aqi", 72, default=F.lit(-1.0), out="m").collect()}
    for (c, t) in probes:
        win = [v for (cc, ts, v) in hist if cc == c and t - dt.timedelta(hours=72) <= ts <= t - dt.timedelta(hours=1)]
        if not win:
            assert rm[(c, t)] == -1.0
        elif all(v is None for v in win):
            assert rm[(c, t)] is None
        else:
            vals = [v for v in win if v is not None]
            assert rm[(c, t)] == sum(vals) / len(vals)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_halo_random_blocks(spark, seed):
    rnd = random.Random(seed)
    df = _series(spark, n=rnd.randint(150, 400), keys=rnd.randint(1, 4), seed=seed, null_share=rnd.random() * 0.5)
    block = rnd.randint(96, 160)
    kw = dict(lags=(72, 96), rolls=(72,), min_periods=24, change_rate="chg")
    a = series_row_features(df, ["city"], "timestamp", ["timestamp"], "aqi", block_rows=block, **kw)
    b = series_row_features(df, ["city"], "timestamp", ["timestamp"], "aqi", method="plain", **kw)
    cols = ["city", "timestamp", "aqi_lag_72h", "aqi_lag_96h", "aqi_rolling_72h", "chg"]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0 and a.count() == b.count()
