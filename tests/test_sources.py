"""Reader edge cases (malformed records, defaults, non-numeric feeds), keep-last duplicates,
current-index fallback with a zero live index."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from hazecast.plans.preprocess import keep_last
from hazecast.plans.scoring import clamp_forecast, current_index
from hazecast.session import scratch_path
from hazecast.sources import payloads as S


def _write(spark, name, docs):
    path = scratch_path(spark, name)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.json"), "w") as f:
        for d in docs:
            f.write((d if isinstance(d, str) else json.dumps(d)) + "\n")
    return path


def test_station_feed_filters(spark):
    docs = [
        {"status": "ok", "data": {"aqi": "57", "iaqi": {"pm25": {"v": 12.5}}, "city": {"name": "A"},
                                  "time": {"s": "2024-01-01 05:00:00"}}},
        {"status": "ok", "data": {"aqi": "-", "iaqi": {}, "city": {"name": "B"}, "time": {"s": "2024-01-01 05:00:00"}}},
        {"status": "error", "data": {"aqi": "80", "city": {"name": "C"}}},
        {"status": "ok", "data": {"aqi": "0", "city": {"name": "D"}, "time": {"s": "2024-01-01 05:00:00"}}},
        "{not json",
    ]
    rows = S.read_station_feed(spark, _write(spark, "feeds", docs)).collect()
    assert [(r["station"], r["aqi"], r["pm25"], r["pm10"]) for r in rows] == [("A", 57.0, 12.5, None)]


def test_air_pollution_defaults_and_rounding(spark):
    docs = [{"dt": 1704067200, "list": [{"components": {"pm2_5": 12.345, "co": 250.126}}]},
            {"dt": 1704070800, "list": []}]
    r = S.read_air_pollution(spark, _write(spark, "air", docs), "x").collect()
    assert len(r) == 1 and r[0]["timestamp"] == dt.datetime(2024, 1, 1, 0, 0)
    assert r[0]["pm25"] == 12.34 and r[0]["pm10"] == 0.0 and r[0]["co"] == 250.13 and r[0]["aqi"] == 52.0  # from unrounded 12.345


def test_weather_now_defaults(spark):
    docs = [{"cod": 200, "dt": 1704067200, "main": {"temp": 20.0, "feels_like": 19.0, "humidity": 40.0,
                                                     "pressure": 1012.0}, "wind": {"speed": 2.0},
             "weather": [{"id": 800}]},
            {"cod": 401, "dt": 1704067200}]
    r = S.read_weather_now(spark, _write(spark, "wnow", docs)).collect()
    assert len(r) == 1 and r[0]["wind_direction"] == 0.0 and r[0]["visibility"] == 10000.0
    assert r[0]["precipitation"] == 0.0 and r[0]["weather_code"] == 800


def test_measurements_skip_bad_rows(spark):
    docs = [{"location_id": 1, "results": [
        {"value": 10.0, "period": {"datetimeFrom": {"utc": "2024-01-01T00:10:00Z"}}},
        {"value": -1.0, "period": {"datetimeFrom": {"utc": "2024-01-01T00:20:00Z"}}},
        {"value": None, "period": {"datetimeFrom": {"utc": "2024-01-01T00:30:00Z"}}},
        {"value": 5.0, "period": {"datetimeFrom": {"utc": "garbage"}}}]}]
    r = S.read_measurements(spark, _write(spark, "meas", docs)).collect()
    assert [(x["timestamp"], x["pm25_raw"]) for x in r] == [(dt.datetime(2024, 1, 1, 0, 10), 10.0)]


def test_forecast_and_archive(spark):
    docs = [{"cod": "200", "list": [{"dt_txt": "2024-01-02 03:00:00", "main": {"temp": 5.0, "feels_like": 3.0,
             "humidity": 80.0, "pressure": 1000.0}, "wind": {"speed": 1.0}, "weather": [{"id": 500}],
             "rain": {"3h": 1.5}}, {"dt_txt": "2024-01-02 06:00:00", "main": {"temp": 6.0}, "wind": {"speed": 1.0, "deg": 90},
             "weather": [{"id": 800}]}]}]
    r = S.read_weather_forecast(spark, _write(spark, "fc", docs)).orderBy("timestamp").collect()
    assert [x["precipitation"] for x in r] == [1.5, 0.0] and [x["wind_direction"] for x in r] == [0.0, 90.0]
    arch = [{"city": "c", "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.0, 2.0],
                                     "relative_humidity_2m": [50.0, None], "weather_code": [3, 61]}}]
    a = S.read_weather_hourly(spark, _write(spark, "arch", arch)).orderBy("timestamp").collect()
    assert [(x["timestamp"].hour, x["temp"], x["humidity"], x["weather_code"]) for x in a] == [(0, 1.0, 50.0, 3), (1, 2.0, None, 61)]


def test_registry_corrupt_gives_empty(spark):
    path = _write(spark, "reg", ["{broken", ""])
    assert S.read_registry(spark, path).count() == 0
    assert S.read_registry(spark, scratch_path(spark, "no-registry")).count() == 0


def test_keep_last_duplicates(spark):
    t = dt.datetime(2024, 1, 1, 5)
    df = spark.createDataFrame([("c", t, 10.0, 1), ("c", t, 30.0, 3), ("c", t, 20.0, 2)],
                               "city string, timestamp timestamp_ntz, aqi double, ingest_seq long")
    assert keep_last(df, ["city", "timestamp"]).first()["aqi"] == 30.0


def test_current_index_zero_is_an_index_and_clamp(spark):
    t = dt.datetime(2024, 1, 1, 5)
    live = spark.createDataFrame([("a", t, 0.0), ("b", t, 80.0)], "city string, timestamp timestamp_ntz, aqi double")
    store = spark.createDataFrame([("a", t, 55.0), ("c", t, None)], "city string, timestamp timestamp_ntz, aqi double")
    got = {r["city"]: (r["current_aqi"], r["source"]) for r in current_index(live, store).collect()}
    assert got == {"a": (0.0, "live"), "b": (80.0, "live"), "c": (100.0, "default")}
    df = spark.createDataFrame([(10.0, 100.0), (300.0, 100.0), (120.04, 100.0), (900.0, 400.0), (None, 1.0)],
                               "raw double, last double")
    assert [r[0] for r in df.select(clamp_forecast(F.col("raw"), F.col("last"))).collect()] == \
        [45.0, 155.0, 120.0, 500.0, None]
