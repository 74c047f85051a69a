"""What must not be lost: rows without an order, columns a batch lacks, a second city in the hour,
offset stamps, third decimals, indented registries, late readings, the old table on a failure."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from hazecast.operators.aggregates import mean_per_timestamp
from hazecast.plans.preprocess import keep_last
from hazecast.session import scratch_path
from hazecast.sinks import files as K
from hazecast.sources import payloads as S
from hazecast.streaming import jobs as X

T0 = dt.datetime(2024, 1, 1)
STORE = "city string, timestamp timestamp_ntz, aqi double, pm25 double, ingest_seq long, day int"


def hours(n, day=1):
    return [("c", T0 + dt.timedelta(hours=i), float(i), i + 0.5, i, day) for i in range(n)]


def test_keep_last_without_an_order(spark):
    df = spark.createDataFrame([("c", T0, 5.0, None), ("d", T0, 6.0, None), ("d", T0, 7.0, 1)],
                               "city string, timestamp timestamp_ntz, aqi double, ingest_seq long")
    assert {r.city: r.aqi for r in keep_last(df, ["city", "timestamp"]).collect()} == {"c": 5.0, "d": 7.0}


def test_upsert_keeps_columns_that_the_batch_lacks(spark):
    target = scratch_path(spark, "t-columns")
    K.write_table(spark.createDataFrame(hours(4), STORE), target, ["day"])
    batch = spark.createDataFrame([("c", T0, 99.0, 9, 1, "new"), ("c", T0 + dt.timedelta(hours=7), 7.0, 9, 1, "new")],
                                  "city string, timestamp timestamp_ntz, aqi double, ingest_seq long, day int, extra string")
    got = {r.timestamp.hour: r for r in K.upsert(spark, target, batch, ["city", "timestamp"], "ingest_seq", ["day"]).collect()}
    assert (got[0].aqi, got[0].pm25, got[0].extra) == (99.0, 0.5, "new")
    assert (got[1].aqi, got[1].pm25, got[1].extra) == (1.0, 1.5, None) and got[7].pm25 is None and len(got) == 5


def test_upsert_touches_only_its_partitions(spark):
    target = scratch_path(spark, "t-touched")
    K.write_table(spark.createDataFrame(hours(3, 1) + [(c, t + dt.timedelta(days=1), a, p, s, 2) for c, t, a, p, s, _ in hours(3)], STORE), target, ["day"])
    before = sorted(os.listdir(f"{target}/day=2"))
    K.upsert(spark, target, spark.createDataFrame([("c", T0, 50.0, 1.0, 5, 1)], STORE), ["city", "timestamp"], "ingest_seq", ["day"])
    assert sorted(os.listdir(f"{target}/day=2")) == before
    assert spark.read.parquet(target).count() == 6


@pytest.mark.parametrize("change", ["upsert", "delete", "reload"])
def test_a_failure_before_the_swap_leaves_the_old_table(spark, monkeypatch, change):
    target = scratch_path(spark, "t-failure")
    K.write_table(spark.createDataFrame(hours(5), STORE), target)

    def fail(*a, **k):
        raise OSError("lost")
    monkeypatch.setattr(K, "_replace", fail)
    with pytest.raises(OSError, match="lost"):
        if change == "upsert":
            K.upsert(spark, target, spark.createDataFrame([("c", T0, 9.0, 1.0, 5, 1)], STORE), ["city", "timestamp"], "ingest_seq")
        elif change == "delete":
            K.delete_where(spark, target, F.col("aqi") > 2)
        else:
            csv = scratch_path(spark, "t-failure-csv")
            spark.createDataFrame(hours(2), STORE).write.option("header", True).csv(csv)
            K.reload_table(spark, csv, target)
    assert sorted(r.aqi for r in spark.read.parquet(target).collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_csv_backup_keeps_cities_apart_and_is_sorted(spark):
    path = scratch_path(spark, "t-csv")
    one = spark.createDataFrame([("a", T0 + dt.timedelta(hours=1), 1.0), ("b", T0, 2.0)], "city string, timestamp timestamp_ntz, aqi double")
    K.merge_csv_backup(spark, path, one)
    two = spark.createDataFrame([("b", T0 + dt.timedelta(hours=1), 3.0), ("a", T0, 4.0), ("b", T0, 5.0)], "city string, timestamp timestamp_ntz, aqi double")
    K.merge_csv_backup(spark, path, two)
    lines = []
    for f in sorted(os.listdir(path.removeprefix("file:"))):
        if f.startswith("part-"):
            with open(os.path.join(path.removeprefix("file:"), f)) as h:
                lines += h.read().splitlines()[1:]
    assert [x.split(",")[0] + x.split(",")[-1] for x in lines] == ["a4.0", "a1.0", "b5.0", "b3.0"]


@pytest.mark.parametrize("text,want", [
    ("2024-01-01T05:00:00+05:00", dt.datetime(2024, 1, 1, 0, 0)), ("2024-01-01T00:00:00+00:00", T0), ("2024-01-01T00:00:00-0330", dt.datetime(2024, 1, 1, 3, 30)),
    ("2024-01-01T00:00:00.123456789Z", dt.datetime(2024, 1, 1, 0, 0, 0, 123456)), ("2024-01-01 00:00:00.5", dt.datetime(2024, 1, 1, 0, 0, 0, 500000)),
    ("2024-01-01T00:00", T0), ("2024-01-01T00:00:00Z", T0), ("2024-13-01T00:00:00Z", None), ("yesterday", None), (None, None)])
def test_iso_stamps(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(S.parse_iso(F.col("s"))).first()[0] == want


def test_third_decimals_count(spark):
    df = spark.createDataFrame([("k", 0.004), ("k", 0.004)], "k string, x double")
    assert mean_per_timestamp(df, ["k"], "x").first().x == 0.004


def test_indented_registry(spark):
    path = scratch_path(spark, "t-registry")
    os.makedirs(path)
    with open(f"{path}/model.json", "w") as f:
        json.dump({"best_model": "gbt", "rmse": 1.5, "all_results": [{"model": "gbt", "rmse": 1.5}]}, f, indent=2)
    assert S.read_registry(spark, path).first().best_model == "gbt"
    with open(f"{path}/model.json", "w") as f:
        f.write("{broken")
    with pytest.warns(UserWarning, match="not readable"):
        assert S.read_registry(spark, path).count() == 0


def test_program_errors_are_not_a_fallback(spark):
    with pytest.raises(ZeroDivisionError):
        S.read_with_fallback(lambda: 1 / 0, lambda: spark.range(1))


EVENTS = "event_id long, ts timestamp_ntz, value double"


def land(spark, folder, rows):
    spark.createDataFrame([(i, T0 + dt.timedelta(hours=h, minutes=m), v) for i, h, m, v in rows], EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_late_readings_a_second_run_and_a_replay(spark):
    landed, table, ckpt = (scratch_path(spark, f"t-late-{n}") for n in ("in", "out", "ckpt"))
    events = lambda: X.stream_files(spark, landed, spark.createDataFrame([], EVENTS).schema, fmt="parquet", max_files=1)
    rows = [(1, 5, 0, 1.0), (2, 20, 0, 8.0)]
    land(spark, landed, rows)
    X.stream_hourly(events(), table, ckpt)
    late = [(3, 5, 30, 3.0), (4, 6, 0, 4.0)]
    land(spark, landed, late)
    want = {5: (2.0, 2), 6: (4.0, 1), 20: (8.0, 1)}
    read = lambda df: {r.timestamp.hour: (r.pm25, r.n_readings) for r in df.collect()}
    assert read(X.stream_hourly(events(), table, ckpt)) == want
    assert read(X.stream_hourly(events(), table, scratch_path(spark, "t-late-ckpt2"))) == want  # all of it once more


def test_change_rate_continues_and_repeats_nothing(spark):
    schema = "city string, timestamp timestamp_ntz, aqi double"
    landed, table, ckpt = (scratch_path(spark, f"t-rate-{n}") for n in ("in", "out", "ckpt"))
    stream = lambda: X.stream_files(spark, landed, spark.createDataFrame([], schema).schema, fmt="parquet")
    put = lambda rows: spark.createDataFrame([("c", T0 + dt.timedelta(hours=h), v) for h, v in rows], schema).coalesce(1).write.mode("append").parquet(landed)
    put([(0, 10.0), (1, 12.5), (2, None), (3, 11.0)])
    X.stream_change_rate(stream(), table, ckpt)
    put([(4, 20.0), (1, 99.0)])
    got = {r.timestamp.hour: (r.aqi, r.aqi_change_rate, r.late) for r in X.stream_change_rate(stream(), table, ckpt).collect()}
    assert got == {0: (10.0, 0.0, False), 1: (99.0, 88.0, True), 2: (None, 0.0, False), 3: (11.0, -1.5, False), 4: (20.0, 9.0, False)}
    X.stream_change_rate(stream(), table, scratch_path(spark, "t-rate-ckpt2"))
    assert spark.read.parquet(table).count() == 5


def test_ingest_continues_where_it_stopped(spark):
    landed, table, ckpt = (scratch_path(spark, f"t-ingest-{n}") for n in ("in", "out", "ckpt"))
    os.makedirs(landed)
    for n in range(2):
        with open(f"{landed}/{n}.json", "w") as f:
            json.dump({"dt": 1704067200 + 3600 * n, "list": [{"components": {"pm2_5": 10.0 + n}}]}, f)
        out = X.stream_ingest(spark, landed, table, "c", ckpt)
    assert out.count() == 2


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from hazecast.session import ensure_checkpoint_dir
    none = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)
