"""Explicit schemas (DDL strings) of landed payloads and tables."""

from __future__ import annotations

from pyspark.sql import types as T

AIR_POLLUTION = (
    "dt BIGINT, list ARRAY<STRUCT<components: STRUCT<pm2_5: DOUBLE, pm10: DOUBLE, no2: DOUBLE, o3: DOUBLE, "
    "co: DOUBLE, so2: DOUBLE>>>")
WEATHER_NOW = (
    "cod INT, dt BIGINT, main STRUCT<temp: DOUBLE, feels_like: DOUBLE, humidity: DOUBLE, pressure: DOUBLE>, "
    "wind STRUCT<speed: DOUBLE, deg: DOUBLE>, visibility DOUBLE, weather ARRAY<STRUCT<id: INT>>, "
    "rain STRUCT<`1h`: DOUBLE>")
WEATHER_ARCHIVE = (
    "city STRING, hourly STRUCT<time: ARRAY<STRING>, temperature_2m: ARRAY<DOUBLE>, "
    "relative_humidity_2m: ARRAY<DOUBLE>, apparent_temperature: ARRAY<DOUBLE>, precipitation: ARRAY<DOUBLE>, "
    "surface_pressure: ARRAY<DOUBLE>, wind_speed_10m: ARRAY<DOUBLE>, wind_direction_10m: ARRAY<DOUBLE>, "
    "visibility: ARRAY<DOUBLE>, weather_code: ARRAY<INT>>")
WEATHER_FORECAST_3H = (
    "cod STRING, list ARRAY<STRUCT<dt_txt: STRING, main: STRUCT<temp: DOUBLE, feels_like: DOUBLE, humidity: DOUBLE, "
    "pressure: DOUBLE>, wind: STRUCT<speed: DOUBLE, deg: DOUBLE>, rain: STRUCT<`3h`: DOUBLE>, "
    "weather: ARRAY<STRUCT<id: INT>>>>")
MEASUREMENTS = (
    "location_id BIGINT, results ARRAY<STRUCT<value: DOUBLE, period: STRUCT<datetimeFrom: STRUCT<utc: STRING>>>>")
LOCATIONS = (
    "results ARRAY<STRUCT<id: BIGINT, name: STRING, coordinates: STRUCT<latitude: DOUBLE, longitude: DOUBLE>, "
    "sensors: ARRAY<STRUCT<parameter: STRUCT<name: STRING>>>, datetimeFirst: STRUCT<utc: STRING>, "
    "datetimeLast: STRUCT<utc: STRING>>>")
STATION_FEED = (
    "status STRING, data STRUCT<aqi: STRING, iaqi: MAP<STRING, STRUCT<v: DOUBLE>>, city: STRUCT<name: STRING>, "
    "time: STRUCT<s: STRING>>")

FEATURE_TABLE = (
    "city STRING, timestamp TIMESTAMP_NTZ, aqi DOUBLE, pm25 DOUBLE, pm10 DOUBLE, no2 DOUBLE, o3 DOUBLE, co DOUBLE, "
    "so2 DOUBLE, temp DOUBLE, feels_like DOUBLE, humidity DOUBLE, pressure DOUBLE, wind_speed DOUBLE, "
    "wind_direction DOUBLE, visibility DOUBLE, precipitation DOUBLE, weather_code INT, weather STRING, hour INT, "
    "day INT, month INT, dayofweek INT, is_weekend INT, is_rush_hour INT, aqi_change_rate DOUBLE, ingest_seq BIGINT")
IMPORTANCE = ("feature STRING, shap_value DOUBLE")


def struct(ddl: str) -> T.StructType:
    """Parse a DDL schema (needs an active session; kept lazy so workers can import this module)."""
    return T.StructType.fromDDL(ddl)

