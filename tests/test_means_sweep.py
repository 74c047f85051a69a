"""Means that hold their values, and lags and range means of one sweep against brute force."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from hazecast.functions.rounding import exact_mean
from hazecast.operators.aggregates import mean_per_timestamp
from hazecast.operators.joins import history_features, range_mean

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("values,want", [
    ([4e-7, 4e-7], 4e-7), ([2e12, 4e12], 3e12), ([float("nan"), 10.0], 10.0), ([None, 3.0], 3.0), ([None, None], None), ([float("nan")], None),
    ([0.1] * 10, 0.1), ([1e300, 3e300], 2e300), ([float("inf"), 1.0], float("inf")), ([9e16, 9e16], 9e16), ([1e17, -1e17, 3.0], 1.0), ([-0.004, 0.004], 0.0)])
def test_means_hold_their_values(spark, values, want):
    df = spark.createDataFrame([("k", v) for v in values], "k string, x double")
    got = df.groupBy("k").agg(exact_mean(F.col("x")).alias("m")).first().m
    assert got == want or got == pytest.approx(want, rel=1e-15)
    row = mean_per_timestamp(df, ["k"], "x").first()
    assert row.x == got and row.n_readings == sum(v is not None and not math.isnan(v) for v in values)


def test_means_of_large_groups_do_not_depend_on_the_order(spark):
    rng = random.Random(1)
    rows = [(i % 3, rng.uniform(-1e6, 1e6)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k long, x double")
    mean = lambda d: sorted(map(tuple, d.groupBy("k").agg(exact_mean(F.col("x"))).collect()))
    assert mean(df.repartition(7)) == mean(df.orderBy(F.desc("x")).repartition(2))


def series(seed, n=300):
    """History with gaps, repeated hours, nulls and NaN; probes around it."""
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float("nan"), 4e-7, rng.uniform(0, 500), float(rng.randint(0, 9))])
    history = [(c, T0 + dt.timedelta(hours=rng.randint(0, 400)), value()) for c in "ab" for _ in range(n // 2)]
    history = list({(c, t): (c, t, v) for c, t, v in history}.values())  # one row an hour
    probes = [(c, T0 + dt.timedelta(hours=h), 7.0 if c != "b" else None) for c in "abz" for h in range(0, 520, 13)]
    return history, probes


def brute(history, probe, lags, rolls):
    city, t, default = probe
    own = sorted((s, v) for c, s, v in history if c == city) if history else []
    out = []
    for n in lags:
        before = [(s, v) for s, v in own if s <= t - dt.timedelta(hours=n)]
        out.append(before[-1][1] if before else default)
    for n in rolls:
        inside = [v for s, v in own if t - dt.timedelta(hours=n) <= s <= t - dt.timedelta(hours=1)]
        real = [v for v in inside if v is not None and not math.isnan(v)]
        out.append(math.fsum(real) / len(real) if real else None if inside else default)
    return out


def same(a, b):
    return a is None and b is None or a is not None and b is not None and (a == pytest.approx(b, rel=1e-12) or math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize("seed,unit", [(0, "day"), (1, "day"), (2, "hour"), (3, "month")])
def test_sweep_equals_brute_force(spark, seed, unit):
    history, probes = series(seed)
    history.sort(key=lambda r: (r[0], r[1]))
    h = spark.createDataFrame(history, "city string, timestamp timestamp_ntz, aqi double").repartition(5)
    p = spark.createDataFrame(probes, "city string, timestamp timestamp_ntz, last double")
    lags, rolls = (1, 72, 96), (24, 72)
    got = history_features(p, h, ["city"], "timestamp", "aqi", lags, rolls, default="last", unit=unit)
    names = [f"aqi_lag_{n}h" for n in lags] + [f"aqi_rolling_{n}h" for n in rolls]
    rows = {(r.city, r.timestamp): [r[n] for n in names] for r in got.collect()}
    assert len(rows) == len(probes)
    for pr in probes:
        want = brute([r for r in history], pr, lags, rolls)
        assert all(same(a, b) for a, b in zip(rows[pr[:2]], want)), (pr, rows[pr[:2]], want)


def test_range_mean_alone_skips_nan(spark):
    h = spark.createDataFrame([("a", T0, float("nan")), ("a", T0 + dt.timedelta(hours=1), 10.0), ("b", T0, float("nan"))],
                              "city string, ts timestamp_ntz, aqi double")
    p = spark.createDataFrame([("a", T0 + dt.timedelta(hours=3)), ("b", T0 + dt.timedelta(hours=3))], "city string, ts timestamp_ntz")
    got = {r.city: r.m for r in range_mean(p, h, ["city"], "ts", "ts", "aqi", 24, out="m").collect()}
    assert got == {"a": 10.0, "b": None}


def test_one_exchange_by_city_and_day(spark):
    history, probes = series(0)
    h = spark.createDataFrame(history, "city string, timestamp timestamp_ntz, aqi double")
    p = spark.createDataFrame(probes, "city string, timestamp timestamp_ntz, last double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = history_features(p, h, ["city"], "timestamp", "aqi", (72, 96), (72, 96), default="last")
        plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (\w+\(.*?\))", plan)
    by_bucket = [cols for cols, by in moved if re.match(r"hashpartitioning\(city#\d+, _bk#", by)]
    assert sum("_end#" in cols for cols in by_bucket) == 1, plan  # history and points go through it once
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
