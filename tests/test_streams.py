"""Hourly sums under replays, corrections and failures; change rates by (city, day) against a plain loop."""

import datetime as dt
import os
import random

import pytest

from hazecast.session import scratch_path
from hazecast.sinks import versions as V
from hazecast.streaming import jobs as X

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, value double"


def events(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), v) for i, m, v in rows], EVENTS)


def hours(df):
    return {int((r.timestamp - T0).total_seconds() // 3600): (r.pm25, r.n_readings) for r in df.collect()}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".parquet")}


def test_sums_take_corrections_and_replays(spark):
    table = scratch_path(spark, "s-sums")
    sums = X.HourlySums(spark, table, "run")
    sums.add(events(spark, [(1, 5, 1.0), (2, 10, 3.0), (3, 70, None)]), 0)
    before = files(f"{table}-readings")
    changed = sums.add(events(spark, [(2, 10, 5.0), (4, 80, 8.0), (1, 5, 1.0)]), 1)  # one corrected, one new, one known
    assert hours(sums.means(changed)) == {0: (3.0, 2), 1: (8.0, 1)}
    assert before < files(f"{table}-readings")  # nothing was rewritten
    again = X.HourlySums(spark, table, "run").add(events(spark, [(2, 10, 5.0), (4, 80, 8.0), (1, 5, 1.0)]), 1)
    assert hours(sums.means(again)) == {0: (3.0, 2), 1: (8.0, 1)}
    other = X.HourlySums(spark, table, "another run").add(events(spark, [(1, 5, 1.0), (2, 10, 5.0), (3, 70, None), (4, 80, 8.0)]), 0)
    assert other.count() == 0
    gone = sums.add(events(spark, [(4, 80, None)]), 2)  # a reading withdrawn
    assert hours(sums.means(gone)) == {1: (None, 0)}


def test_a_failure_between_the_two_tables(spark, monkeypatch):
    table = scratch_path(spark, "s-failure")
    sums = X.HourlySums(spark, table, "run")
    sums.add(events(spark, [(1, 5, 1.0)]), 0)
    append = X.HourlySums._append

    def fails(self, to, *a):
        if to is self.sums:
            raise OSError("lost")
        append(self, to, *a)
    monkeypatch.setattr(X.HourlySums, "_append", fails)
    batch = events(spark, [(2, 6, 3.0), (3, 65, 7.0)])
    with pytest.raises(OSError, match="lost"):
        sums.add(batch, 1)
    monkeypatch.setattr(X.HourlySums, "_append", append)
    assert hours(sums.means(sums.add(batch, 1))) == {0: (2.0, 2), 1: (7.0, 1)}
    assert V.read_table(spark, f"{table}-readings").count() == 3


def test_many_files_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(X, "MANY_FILES", 2)
    table = scratch_path(spark, "s-many")
    sums = X.HourlySums(spark, table, "run")
    for n in range(4):
        changed = sums.add(events(spark, [(n, 5, float(n))]), n)
        sums.tidy()
    assert len(files(f"{table}-readings")) <= 3 and len(files(f"{table}-sums")) <= 3
    assert hours(sums.means(changed)) == {0: (1.5, 4)}


def plain_rates(batches):
    """The rule, row by row: (city, hour) -> rate and lateness of the rows that move or follow."""
    last, out = {}, []
    for batch in batches:
        state = dict(last)
        for city in sorted({c for c, *_ in batch}):
            rows = sorted([r for r in batch if r[0] == city], key=lambda r: (r[1], r[2] is None, r[2] or 0))
            at = state.get(city)
            for i, (c, t, v) in enumerate(rows):
                late = at is not None and t <= at[0]
                rate = 0.0 if at is None or v is None else float(round((v - at[1]) * 100)) / 100
                out.append((c, t, v, rate, late))
                if v is not None and not late:
                    at = (t, v)
            if at is not None:
                last[city] = at
    return out


@pytest.mark.parametrize("seed", range(4))
def test_change_rates_equal_the_rule(spark, seed):
    rng = random.Random(seed)
    stamps = [T0 + dt.timedelta(hours=h) for h in range(200)]
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), rng.choice(stamps), rng.choice([None, float(rng.randint(0, 400)) / 4])) for _ in range(240)]
    rows = sorted(set(rows), key=lambda r: rng.random())
    batches = [rows[:100], rows[100:160], rows[160:]]
    last, got = spark.createDataFrame([], X.LAST_INDEX), []
    for b in batches:
        df = spark.createDataFrame(b, "city string, timestamp timestamp_ntz, aqi double").repartition(3)
        out, last = X.change_rates(df, last)
        got += [tuple(r) for r in out.collect()]
        last = spark.createDataFrame(last.collect(), last.schema)
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)
    assert sorted(got, key=key) == sorted(plain_rates(batches), key=key)


def test_files_in_any_order_and_the_plan(spark):
    """One micro-batch of files in any order gives the rates of the ordered series; windows by (city, day)."""
    rng = random.Random(9)
    rows = [("busy", T0 + dt.timedelta(hours=h), float(h * h % 97)) for h in range(300)]
    shuffled = sorted(rows, key=lambda r: rng.random())
    df = spark.createDataFrame(shuffled, "city string, timestamp timestamp_ntz, aqi double").repartition(6)
    out, _ = X.change_rates(df, spark.createDataFrame([], X.LAST_INDEX))
    got = {r.timestamp: (r.aqi_change_rate, r.late) for r in out.collect()}
    assert got == {t: (v - rows[i - 1][2] if i else 0.0, False) for i, (_, t, v) in enumerate(rows)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    import re
    assert "Python" not in plan and "SinglePartition" not in plan
    # rows are windowed by (city, day); by city alone only the summary, a row per (city, day)
    assert re.search(r"hashpartitioning\(city#\d+, _bk#\d+", plan)
    by_city = re.findall(r"Window \[last\((_\w+)#\d+, true\).*?\], \[city#\d+\], \[_bk", plan)
    assert set(by_city) == {"_top"}


def test_stream_of_change_rates_over_files(spark):
    rng = random.Random(3)
    rows = [("busy", T0 + dt.timedelta(hours=h), float(rng.randint(0, 300))) for h in range(60)]
    landed, table, ckpt = (scratch_path(spark, f"s-rates-{n}") for n in ("in", "out", "ckpt"))
    schema = "city string, timestamp timestamp_ntz, aqi double"
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(sorted(part, key=lambda r: rng.random()), schema).repartition(3).write.mode("append").parquet(landed)
        out = X.stream_change_rate(X.stream_files(spark, landed, spark.createDataFrame([], schema).schema, fmt="parquet"), table, ckpt)
    got = {r.timestamp: r.aqi_change_rate for r in out.collect()}
    assert got == {t: (v - rows[i - 1][2] if i else 0.0) for i, (_, t, v) in enumerate(rows)}
