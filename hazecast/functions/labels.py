"""Display labels: month names, weekday names, feature names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Readable names for model features; others are title-cased.
FEATURE_DISPLAY_NAMES = {
    "wind_speed": "Wind speed", "aqi_rolling_72h": "AQI 3-day avg", "aqi_lag_72h": "AQI lag 72h",
    "aqi_lag_96h": "AQI lag 96h", "aqi_rolling_96h": "AQI 4-day avg", "month_cos": "Month (cyclical)",
    "month_sin": "Month Sin", "hour_cos": "Hour (cyclical)", "hour_sin": "Hour Sin",
    "is_rush_hour": "Rush hour", "humidity": "Humidity", "temp": "Temperature",
    "temp_humidity": "Temp × humidity", "wind_humidity": "Wind × humidity",
    "is_stagnant": "Stagnant air", "precipitation": "Precipitation",
}


def month_name(ts_or_date: Column) -> Column:
    return F.date_format(ts_or_date, "MMM")


def weekday_name(ts_or_date: Column) -> Column:
    return F.date_format(ts_or_date, "EEEE")


def day_label(ts_or_date: Column) -> Column:
    return F.date_format(ts_or_date, "MMM dd")


def feature_display_name(feature: Column) -> Column:
    m = F.create_map(*[x for k, v in FEATURE_DISPLAY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[feature], F.initcap(F.regexp_replace(feature, "_", " ")))
