"""Forecast scoring: history-aware features for future weather rows, batch prediction,
clamping, and the current-index fallback chain.

The reference scores 72 rows one at a time with four scans of the history
per row.  Here one plan builds every feature: calendar and weather columns
are expressions, and the time-based history features are as-of / range
operators over the feature store (no per-row scans).  A single
``model.transform`` predicts all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import weather as wx
from ..functions.rounding import round_half_even
from ..operators.joins import history_features
from ..operators.ordering import latest_per_key

# Clamp factors around the current index, output bounds, final fallback.
CLAMP_LOW, CLAMP_HIGH = 0.45, 1.55
OUTPUT_MIN, OUTPUT_MAX = 0.0, 500.0
FALLBACK_AQI = 100.0


def clamp_forecast(raw: Column, last: Column, digits: int = 1) -> Column:
    """clip(raw, 0.45 x last, 1.55 x last), round, then bound to 0..500; null or NaN gives null."""
    lo, hi = last * F.lit(CLAMP_LOW), last * F.lit(CLAMP_HIGH)
    clipped = F.when(raw < lo, lo).when(raw > hi, hi).otherwise(raw)
    r = round_half_even(clipped, digits)
    bounded = F.when(r > OUTPUT_MAX, F.lit(OUTPUT_MAX)).when(r < OUTPUT_MIN, F.lit(OUTPUT_MIN)).otherwise(r)
    bad = raw.isNull() | last.isNull() | F.isnan(raw) | F.isnan(last)
    return F.when(bad, F.lit(None).cast("double")).otherwise(bounded)


def floor_zero(raw: Column) -> Column:
    """The plain variant: negative predictions become 0."""
    return F.when(raw < 0, F.lit(0.0)).otherwise(raw)


def current_index(live: DataFrame, store: DataFrame, keys: Sequence[str] = ("city",), ts: str = "timestamp",
                  value: str = "aqi") -> DataFrame:
    """Per key: the live index, else the newest stored index, else 100; with its source.

    An index of 0 is an index; only null is missing.
    """
    lv = latest_per_key(live.filter(F.col(value).isNotNull()), keys, ts, [value]) \
        .select(*keys, F.col(value).alias("_live"))
    st = latest_per_key(store.filter(F.col(value).isNotNull()), keys, ts, [value]) \
        .select(*keys, F.col(value).alias("_stored"))
    allk = live.select(*keys).unionByName(store.select(*keys)).distinct()
    j = allk.join(lv, list(keys), "left").join(st, list(keys), "left")
    src = F.when(F.col("_live").isNotNull(), F.lit("live")).when(F.col("_stored").isNotNull(), F.lit("store")) \
        .otherwise(F.lit("default"))
    return j.select(*keys, F.coalesce("_live", "_stored", F.lit(FALLBACK_AQI)).alias("current_aqi"),
                    src.alias("source"))


def forecast_features(forecast: DataFrame, history: DataFrame, current: DataFrame,
                      keys: Sequence[str] = ("city",), ts: str = "timestamp", cyclical_digits: int | None = 9,
                      lags: Sequence[int] = (72, 96), rolls: Sequence[int] = (72, 96)) -> DataFrame:
    """Model inputs for future weather rows (scoring definition: time-based history features).

    ``current``: one row per key with ``current_aqi`` (the default when history has no match).
    """
    keys = list(keys)
    f = wx.apply_scoring_defaults(forecast).join(current.select(*keys, "current_aqi"), keys, "left")
    t = F.col(ts)
    parts = cal.calendar_parts(t)
    f = f.withColumns({k: parts[k] for k in ("hour", "month", "dayofweek", "is_weekend", "is_rush_hour")})
    hs, hc = cal.cyclical(F.col("hour"), 24, cyclical_digits)
    ms, mc = cal.cyclical(F.col("month"), 12, cyclical_digits)
    temp, hum, wind = F.col("temp"), F.col("humidity"), F.col("wind_speed")
    f = f.withColumns({"hour_sin": hs, "hour_cos": hc, "month_sin": ms, "month_cos": mc,
                       "season": cal.season(F.col("month")), **wx.weather_flags(temp, wind),
                       "is_stagnant": wx.is_stagnant(wind, hum), **wx.interactions(temp, hum, wind)})
    return history_features(f, history, keys, ts, "aqi", lags, rolls, default="current_aqi")


def score_forecast(model, features: DataFrame, keys: Sequence[str] = ("city",), ts: str = "timestamp") -> DataFrame:
    """One batch ``transform`` of a fitted pipeline (which imputes and scales into columns of its
    own) for all rows, then the clamp around the current index; the weather is that of the forecast."""
    out = model.transform(features).withColumn("predicted_aqi", clamp_forecast(F.col("prediction"), F.col("current_aqi")))
    return out.select(*keys, ts, "predicted_aqi", "temp", "humidity", "wind_speed", "precipitation",
                      F.to_date(F.col(ts)).cast("timestamp_ntz").alias("date"), "hour")
