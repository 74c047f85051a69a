"""History builds: measured (M1), estimated (M2) and the live row (M3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import estimate as est
from ..functions.aqi import pm25_to_aqi
from ..functions.rounding import round_half_even
from ..operators.aggregates import mean_per_timestamp
from ..operators.joins import align_hourly, latest_per_key
from ..operators.windows import series_row_features
from ..session import broadcast_if_small

# Column order of the feature table.
FEATURE_TABLE_COLS = ["city", "timestamp", "aqi", "pm25", "pm10", "no2", "o3", "co", "so2", "temp", "feels_like",
                      "humidity", "pressure", "wind_speed", "wind_direction", "visibility", "precipitation",
                      "weather_code", "weather", "hour", "day", "month", "dayofweek", "is_weekend",
                      "is_rush_hour", "aqi_change_rate", "ingest_seq"]


def add_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns(cal.calendar_parts(F.col(ts)))


def build_history(weather: DataFrame, readings: DataFrame, keys: Sequence[str] = ("city",),
                  digits: int = 0, gap_policy: str = "truncate", method: str = "halo") -> DataFrame:
    """Measured history: align on the hour, index from PM2.5, calendar, change rate, drop null index."""
    j = align_hourly(weather, readings, [*keys, "timestamp"])
    j = j.withColumn("aqi", pm25_to_aqi(F.col("pm25"), digits, gap_policy))
    j = add_calendar(j)
    if "weather" not in j.columns:
        j = j.withColumn("weather", F.lit(None).cast("string"))
    j = series_row_features(j, keys, "timestamp", ["timestamp"], "aqi", change_rate="aqi_change_rate",
                            method=method)
    return j.filter(F.col("aqi").isNotNull()).select(*FEATURE_TABLE_COLS)


def backfill_measured(measurements: DataFrame, weather: DataFrame, keys: Sequence[str] = ("city",), digits: int = 1,
                      pm25_digits: int = 2, gap_policy: str = "truncate", method: str = "halo") -> DataFrame:
    """Raw measurements of several locations (keys, timestamp, pm25_raw; UTC) and hourly weather ->
    feature rows: nearest hour, mean over the locations, index, calendar, change rate."""
    stamped = measurements.withColumn("timestamp", cal.round_hour(F.col("timestamp")))
    hourly = mean_per_timestamp(stamped, [*keys, "timestamp"], "pm25_raw", "pm25")
    j = align_hourly(weather, hourly, [*keys, "timestamp"])
    j = j.withColumn("aqi", pm25_to_aqi(F.col("pm25"), digits, gap_policy)).withColumn("pm25", round_half_even(F.col("pm25"), pm25_digits))
    j = series_row_features(add_calendar(j), keys, "timestamp", ["timestamp"], "aqi", change_rate="aqi_change_rate", method=method)
    return j.filter(F.col("aqi").isNotNull())


def estimate_history(weather: DataFrame, reference: DataFrame, version: str = "monthly",
                     keys: Sequence[str] = ("city",), noise_seed: int | None = None,
                     method: str = "halo") -> DataFrame:
    """Estimated history from weather (no row loop): index estimate, pollutants, calendar, change rate.

    ``reference``: one row per key with ``aqi_now, pm25, pm10, no2, o3, co, so2``.
    """
    j = weather.join(broadcast_if_small(reference), list(keys), "left")
    ts = F.col("timestamp")
    h, w, t, r = F.col("humidity"), F.col("wind_speed"), F.col("temp"), F.col("precipitation")
    if version == "current":
        e = est.estimate_aqi_current(ts, h, w, t, r, F.col("aqi_now"), noise_seed)
        j = j.withColumn("_est", e)
        pol = {c: est.scale_by_ratio(F.col(c), F.col("_est"), F.col("aqi_now"))
               for c in ["pm25", "pm10", "no2", "o3", "co", "so2"]}
    else:
        e = est.estimate_aqi_monthly(ts, h, w, t, r, noise_seed)
        j = j.withColumn("_est", e)
        pol = {**est.scale_from_baseline(ts, F.col("_est")),
               **{c: est.scale_by_pollutant_ratio(F.col(c), F.col("aqi_now"), F.col("_est"))
                  for c in ["no2", "o3", "co", "so2"]}}
    j = j.withColumns(pol).withColumn("aqi", F.col("_est")).drop("_est", "aqi_now")
    j = add_calendar(j)
    if "weather" not in j.columns:
        j = j.withColumn("weather", F.lit(None).cast("string"))
    if "ingest_seq" not in j.columns:
        j = j.withColumn("ingest_seq", F.lit(None).cast("long"))
    j = series_row_features(j, keys, "timestamp", ["timestamp"], "aqi", change_rate="aqi_change_rate",
                            method=method)
    return j.select(*FEATURE_TABLE_COLS)


def engineer_live(readings: DataFrame, weather: DataFrame, store: DataFrame,
                  keys: Sequence[str] = ("city",)) -> DataFrame:
    """Live rows: reading + weather + calendar; change rate vs the newest stored index per key."""
    j = readings.join(weather, [*keys, "timestamp"], "inner")
    j = add_calendar(j)
    last = latest_per_key(store.filter(F.col("aqi").isNotNull()), keys, "timestamp", ["aqi"]) \
        .withColumnRenamed("aqi", "_last_aqi")
    j = j.join(broadcast_if_small(last), list(keys), "left")
    rate = F.when(F.col("_last_aqi").isNull(), F.lit(0.0)).otherwise(round_half_even(F.col("aqi") - F.col("_last_aqi"), 2))
    return j.withColumn("aqi_change_rate", rate).drop("_last_aqi")
