"""Expression, filter, aggregate and ordering queries over the driver-table bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ..catalog import register
from ..functions import calendar as cal
from ..functions import weather as wx
from ..functions.aqi import aqi_category, aqi_category4, aqi_color, pm25_to_aqi
from ..functions.rounding import exact_mean, round_half_even
from ..operators import aggregates as agg
from ..sources import bindings as B

W = O.with_ctes
C = O.base_ctes


# ---------------------------------------------------------------- flagship slice
def daily_aqi(spark, sf):
    """events -> hourly mean PM2.5 -> index -> daily mean index and category."""
    return agg.daily_mean(B.obs_hourly(spark, sf), ["city"]).select("city", "date", "avg_aqi", "category")


register("daily_aqi", W(*C(), body=f"""
SELECT city, CAST(CAST(timestamp AS DATE) AS TIMESTAMP) AS date, {O.emean('aqi')} AS avg_aqi,
       {O.category_sql(O.emean('aqi'))} AS category
FROM obs_hourly GROUP BY city, CAST(CAST(timestamp AS DATE) AS TIMESTAMP)"""), "A3 P1 P2 A1")(daily_aqi)


# ---------------------------------------------------------------- P1-P3
@register("aqi_reference_policy", W(*C(), body="SELECT city, timestamp, pm25, aqi FROM obs_hourly"), "P1")
def aqi_reference_policy(spark, sf):
    return B.obs_hourly(spark, sf).select("city", "timestamp", "pm25", "aqi")


@register("aqi_truncate_one_decimal", W(*C(), body=f"""
SELECT city, timestamp, pm25, {O.aqi_sql('pm25', 1, 'truncate')} AS aqi FROM obs_hourly"""), "P1")
def aqi_truncate_one_decimal(spark, sf):
    h = B.obs_hourly(spark, sf)
    return h.select("city", "timestamp", "pm25", pm25_to_aqi(F.col("pm25"), 1, "truncate").alias("aqi"))


@register("aqi_raw_readings", W(*C(), body=f"""
SELECT ingest_seq, pm25_raw, {O.aqi_sql('pm25_raw', 1, 'reference')} AS aqi_1dp,
       {O.aqi_sql('pm25_raw', 0, 'truncate')} AS aqi_trunc FROM obs_raw"""), "P1")
def aqi_raw_readings(spark, sf):
    r = B.obs_raw(spark, sf)
    return r.select("ingest_seq", "pm25_raw", pm25_to_aqi(F.col("pm25_raw"), 1, "reference").alias("aqi_1dp"),
                    pm25_to_aqi(F.col("pm25_raw"), 0, "truncate").alias("aqi_trunc"))


@register("aqi_categories", W(*C(), body=f"""
SELECT city, timestamp, aqi, {O.category_sql('aqi')} AS category, {O.color_sql('aqi')} AS color,
       {O.category4_sql('aqi')} AS category4 FROM obs_hourly"""), "P2 P3")
def aqi_categories(spark, sf):
    h = B.obs_hourly(spark, sf)
    return h.select("city", "timestamp", "aqi", aqi_category(F.col("aqi")).alias("category"),
                    aqi_color(F.col("aqi")).alias("color"), aqi_category4(F.col("aqi")).alias("category4"))


# ---------------------------------------------------------------- P5-P9, P13, P16, P17
@register("calendar_parts", W(*C(), body="""
SELECT city, timestamp, hour(timestamp) AS hour, day(timestamp) AS day, month(timestamp) AS month,
       isodow(timestamp) - 1 AS dayofweek, CAST(isodow(timestamp) - 1 >= 5 AS INTEGER) AS is_weekend,
       CAST(hour(timestamp) IN (7, 8, 9, 17, 18, 19) AS INTEGER) AS is_rush_hour
FROM obs_hourly"""), "P5 P6 P7")
def calendar_parts(spark, sf):
    h = B.obs_hourly(spark, sf)
    parts = cal.calendar_parts(F.col("timestamp"))
    return h.select("city", "timestamp", *[c.alias(n) for n, c in parts.items()])


def _cyc_sql(x, period, fn):
    return O.rhe(f"{fn}({O.D(2 * 3.141592653589793)} * CAST({x} AS DOUBLE) / {O.D(float(period))})", 9)


@register("cyclical_features", W(*C(), body=f"""
SELECT date, month(date) AS month, {_cyc_sql('month(date)', 12, 'sin')} AS month_sin,
       {_cyc_sql('month(date)', 12, 'cos')} AS month_cos,
       {_cyc_sql('n_readings % 24', 24, 'sin')} AS hour_sin, {_cyc_sql('n_readings % 24', 24, 'cos')} AS hour_cos
FROM daily_long"""), "P8")
def cyclical_features(spark, sf):
    d = B.daily_long(spark, sf)
    ms, mc = cal.cyclical(F.month("date"), 12, digits=9)
    hs, hc = cal.cyclical(F.col("n_readings") % 24, 24, digits=9)
    return d.select("date", F.month("date").alias("month"), ms.alias("month_sin"), mc.alias("month_cos"),
                    hs.alias("hour_sin"), hc.alias("hour_cos"))


@register("season_of_month", W(*C(), body="""
SELECT date, month(date) AS month,
       CASE WHEN month(date) IN (12, 1, 2) THEN 0 WHEN month(date) IN (3, 4, 5) THEN 1
            WHEN month(date) IN (6, 7, 8) THEN 2 ELSE 3 END AS season FROM daily_long"""), "P9")
def season_of_month(spark, sf):
    d = B.daily_long(spark, sf)
    return d.select("date", F.month("date").alias("month"), cal.season(F.month("date")).alias("season"))


@register("timestamp_text", W(*C(), body="""
SELECT ingest_seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text,
       CAST(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS ts_parsed,
       CAST(NULL AS TIMESTAMP) AS bad_parsed
FROM obs_raw"""), "P13")
def timestamp_text(spark, sf):
    r = B.obs_raw(spark, sf)
    txt = cal.format_ts(F.col("ts"))
    return r.select("ingest_seq", txt.alias("ts_text"), cal.parse_ts(txt).alias("ts_parsed"),
                    cal.parse_ts(F.col("station")).alias("bad_parsed"))


@register("local_time", W(*C(), body="""
SELECT city, timestamp, timestamp + INTERVAL 5 HOUR AS local_ts,
       timestamp + INTERVAL 5 HOUR - INTERVAL 5 HOUR AS back_to_utc FROM obs_hourly"""), "P16")
def local_time(spark, sf):
    h = B.obs_hourly(spark, sf)
    loc = cal.to_local(F.col("timestamp"), "Asia/Karachi")
    return h.select("city", "timestamp", loc.alias("local_ts"), cal.to_utc(loc, "Asia/Karachi").alias("back_to_utc"))


@register("round_to_hour", W(*C(), body="""
SELECT ingest_seq, ts,
  CASE WHEN epoch_us(ts) - epoch_us(date_trunc('hour', ts)) > 1800000000 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR
       WHEN epoch_us(ts) - epoch_us(date_trunc('hour', ts)) < 1800000000 THEN date_trunc('hour', ts)
       WHEN hour(ts) % 2 = 1 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR ELSE date_trunc('hour', ts) END AS hour_ts
FROM obs_raw"""), "P17")
def round_to_hour(spark, sf):
    r = B.obs_raw(spark, sf)
    return r.select("ingest_seq", "ts", cal.round_hour(F.col("ts")).alias("hour_ts"))


# ---------------------------------------------------------------- P10-P12, P26, P27
@register("weather_interactions", W(*C(), body="""
SELECT city, timestamp, temp * humidity AS temp_humidity, wind_speed * humidity AS wind_humidity,
  CAST(COALESCE(wind_speed < 2 AND humidity > 70, FALSE) AS INTEGER) AS is_stagnant,
  CAST(COALESCE(temp > 35, FALSE) AS INTEGER) AS is_hot, CAST(COALESCE(temp < 10, FALSE) AS INTEGER) AS is_cold,
  CAST(COALESCE(wind_speed < 2, FALSE) AS INTEGER) AS is_calm_wind,
  CAST(COALESCE(wind_speed > 8, FALSE) AS INTEGER) AS is_strong_wind
FROM weather_hourly"""), "P10 P11 P12")
def weather_interactions(spark, sf):
    w = B.weather_hourly(spark, sf)
    t, h, ws = F.col("temp"), F.col("humidity"), F.col("wind_speed")
    cols = {**wx.interactions(t, h, ws), "is_stagnant": wx.is_stagnant(ws, h), **wx.weather_flags(t, ws)}
    return w.select("city", "timestamp", *[c.alias(n) for n, c in cols.items()])


@register("weather_defaults", W(*C(), body=f"""
SELECT city, timestamp, COALESCE(temp, {O.D(30.0)}) AS temp, COALESCE(feels_like, COALESCE(temp, {O.D(30.0)})) AS feels_like,
  COALESCE(humidity, {O.D(50.0)}) AS humidity, COALESCE(pressure, {O.D(1010.0)}) AS pressure,
  COALESCE(wind_speed, {O.D(3.0)}) AS wind_speed, COALESCE(wind_direction, {O.D(180.0)}) AS wind_direction,
  COALESCE(precipitation, {O.D(0.0)}) AS precipitation, COALESCE(weather_code, 0) AS weather_code
FROM weather_hourly"""), "P26")
def weather_defaults(spark, sf):
    w = B.weather_hourly(spark, sf).drop("visibility")
    return wx.apply_scoring_defaults(w)


def _group_sql(code, groups):
    return "CASE " + " ".join(f"WHEN {code} BETWEEN {a} AND {b} THEN '{g}'" for a, b, g in groups) + " END"


_CODED = """coded AS (
  SELECT city, timestamp, CASE WHEN hour(timestamp) % 3 = 0 THEN 'archive' WHEN hour(timestamp) % 3 = 1 THEN 'current' ELSE 'forecast3h' END AS src,
         CASE WHEN hour(timestamp) % 3 = 0 THEN weather_code ELSE 200 + weather_code * 13 % 605 END AS code, wind_speed, precipitation
  FROM weather_hourly)"""


@register("weather_codes", W(*C(_CODED), body=f"""
SELECT city, timestamp, src AS unit_source, g AS weather_group,
  CASE WHEN src = 'archive' THEN code ELSE CASE g {' '.join(f"WHEN '{k}' THEN {v}" for k, v in wx.GROUP_CODE.items())} END END AS weather_code,
  CASE WHEN src = 'archive' THEN wind_speed / {O.D(3.6)} ELSE wind_speed END AS wind_speed,
  CASE WHEN src = 'forecast3h' THEN precipitation / {O.D(3.0)} ELSE precipitation END AS precipitation
FROM (SELECT *, CASE WHEN src = 'archive' THEN {_group_sql('code', wx.WMO_GROUPS)} ELSE {_group_sql('code', wx.CONDITION_GROUPS)} END AS g FROM coded) c"""),
          "P19")
def weather_codes(spark, sf):
    """Readings of three sources in their own units and codes, brought together."""
    w, third = B.weather_hourly(spark, sf), F.hour("timestamp") % 3
    source = F.when(third == 0, "archive").when(third == 1, "current").otherwise("forecast3h")
    code = F.when(third == 0, F.col("weather_code")).otherwise(200 + F.col("weather_code") * 13 % 605)
    got = wx.normalise_units(w.withColumn("weather_code", code), source)
    return got.select("city", "timestamp", "unit_source", "weather_group", "weather_code", "wind_speed", "precipitation")


@register("display_defaults", W(*C(_CODED), body=f"""
SELECT city, timestamp, COALESCE(temp, {O.D(25.0)}) AS temp, COALESCE(feels_like, temp, {O.D(25.0)}) AS feels_like,
  COALESCE(humidity, {O.D(50.0)}) AS humidity, COALESCE(pressure, {O.D(1013.0)}) AS pressure,
  COALESCE(wind_speed, {O.D(0.0)}) AS wind_speed, COALESCE(wind_direction, {O.D(0.0)}) AS wind_direction FROM weather_hourly"""), "P26")
def display_defaults(spark, sf):
    """The conditions that a display shows where a reading lacks them."""
    return wx.apply_display_defaults(B.weather_hourly(spark, sf)).select(
        "city", "timestamp", "temp", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction")


@register("floored_forecast", W(*C(), body=f"""
SELECT city, timestamp, CASE WHEN raw < 0 THEN {O.D(0.0)} ELSE raw END AS predicted_aqi FROM (
  SELECT city, timestamp, 2 * aqi - LAG(aqi, 1) OVER (PARTITION BY city ORDER BY timestamp) * 2 AS raw FROM obs_hourly) f"""), "P25")
def floored_forecast(spark, sf):
    """A linear continuation of the index, which falls below 0 at times, with the plain floor."""
    from ..operators.windows import halo_window
    from ..plans.scoring import floor_zero
    h = B.obs_hourly(spark, sf)
    raw = halo_window(h, ["city"], "timestamp", ["timestamp"], {"_raw": lambda w: 2 * F.col("aqi") - F.lag("aqi", 1).over(w) * 2}, reach=1)
    return raw.select("city", "timestamp", floor_zero(F.col("_raw")).alias("predicted_aqi"))


@register("condition_bands", W(*C(), body="""
SELECT city, timestamp,
  CASE WHEN temp IS NULL THEN NULL WHEN temp >= 40 THEN 'very hot' WHEN temp >= 30 THEN 'hot'
       WHEN temp >= 20 THEN 'warm' WHEN temp >= 10 THEN 'mild' ELSE 'cold' END AS temp_band,
  CASE WHEN humidity IS NULL THEN NULL WHEN humidity < 40 THEN 'dry' WHEN humidity < 70 THEN 'comfortable'
       ELSE 'humid' END AS humidity_band,
  CASE WHEN pressure IS NULL THEN NULL WHEN pressure >= 1005 AND pressure <= 1025 THEN 'Normal'
       WHEN pressure > 1025 THEN 'High' ELSE 'Low' END AS pressure_band
FROM weather_hourly"""), "P27")
def condition_bands(spark, sf):
    w = B.weather_hourly(spark, sf)
    return w.select("city", "timestamp", wx.temperature_band(F.col("temp")).alias("temp_band"),
                    wx.humidity_band(F.col("humidity")).alias("humidity_band"),
                    wx.pressure_band(F.col("pressure")).alias("pressure_band"))


# ---------------------------------------------------------------- A1-A8, F2, F6, F7
@register("hourly_mean", W(*C(), body=f"""
SELECT city, timestamp, {O.emean('pm25_raw', 9)} AS pm25, COUNT(pm25_raw) AS n_readings
FROM dup_hourly GROUP BY city, timestamp"""), "A1")
def hourly_mean(spark, sf):
    return agg.mean_per_timestamp(B.dup_hourly(spark, sf), ["city", "timestamp"], "pm25_raw", "pm25")


@register("hour_of_day_mean", W(*C(), body=f"""
SELECT city, hour(timestamp) AS hour, {O.emean('aqi')} AS avg_aqi, {O.category_sql(O.emean('aqi'))} AS category
FROM obs_hourly GROUP BY city, hour(timestamp)"""), "A4")
def hour_of_day_mean(spark, sf):
    return agg.hour_of_day_mean(B.obs_hourly(spark, sf))


@register("month_mean", W(*C(), body=f"""
SELECT city, month, avg_aqi, month_name, {O.category_sql('avg_aqi')} AS category FROM (
  SELECT city, month(timestamp) AS month, {O.rhe(O.emean('aqi'), 1)} AS avg_aqi,
         strftime(make_date(2000, month(timestamp), 1), '%b') AS month_name
  FROM daily_long GROUP BY city, month(timestamp)) m"""), "A5 P28")
def month_mean(spark, sf):
    return agg.month_mean(B.daily_long(spark, sf), digits=1)


@register("station_average", W(*C(), body=f"""
SELECT city, round_even({O.emean('aqi')}, 0) AS avg_aqi, COUNT(aqi) AS stations_used FROM (
  SELECT '{B.DEFAULT_CITY}' AS city, station, arg_max(aqi, timestamp) AS aqi FROM station_hourly GROUP BY station) s
GROUP BY city"""), "A7")
def station_average(spark, sf):
    s = B.station_hourly(spark, sf)
    latest = s.groupBy("station").agg(F.max_by("aqi", "timestamp").alias("aqi")).withColumn("city", F.lit(B.DEFAULT_CITY))
    return agg.station_average(latest)


@register("value_ranges", W(*C(), body="""
SELECT city, MIN(aqi) AS min_aqi, MAX(aqi) AS max_aqi, MIN(pm25) AS min_pm25, MAX(pm25) AS max_pm25
FROM obs_hourly GROUP BY city"""), "A8")
def value_ranges(spark, sf):
    return agg.value_ranges(B.obs_hourly(spark, sf), ["city"], ["aqi", "pm25"])


@register("valid_measurements", W(*C(), body="""
SELECT ingest_seq, ts, pm25_raw FROM obs_raw WHERE pm25_raw IS NOT NULL AND NOT isnan(pm25_raw) AND pm25_raw >= 0"""),
          "F2 S4")
def valid_measurements(spark, sf):
    from ..operators.filters import valid_measurement
    r = B.obs_raw(spark, sf)
    return r.filter(valid_measurement(F.col("pm25_raw"))).select("ingest_seq", "ts", "pm25_raw")


@register("alerts", W(*C(), body=f"""
SELECT city, timestamp, aqi, {O.category_sql('aqi')} AS category FROM obs_hourly WHERE aqi > 150"""), "F6")
def alerts(spark, sf):
    from ..operators.filters import alerts as _alerts
    return _alerts(B.obs_hourly(spark, sf)).select("city", "timestamp", "aqi", "category")


@register("usable_columns", W(*C(), body="""
SELECT city, COUNT(pm25) AS pm25, COUNT(pm10) AS pm10, COUNT(no2) AS no2, COUNT(o3) AS o3, COUNT(co) AS co,
       COUNT(so2) AS so2, COUNT(pm25) > 20 AS pm25_outlier_gate, COUNT(so2) > 10 AS so2_impute_gate
FROM params_hourly GROUP BY city"""), "F7")
def usable_columns(spark, sf):
    from ..operators.filters import nonnull_counts
    c = nonnull_counts(B.params_hourly(spark, sf), ["city"], B.POLLUTANTS)
    return c.withColumns({"pm25_outlier_gate": F.col("pm25") > 20, "so2_impute_gate": F.col("so2") > 10})


@register("row_count", W(*C(), body="SELECT COUNT(*) AS rows FROM obs_hourly"), "A14")
def row_count(spark, sf):
    return agg.row_count(B.obs_hourly(spark, sf))


_WCOLS = ["temp", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction", "precipitation",
          "visibility"]


@register("bad_value_count", W(*C(), body="SELECT CAST(" + " + ".join(
    f"COALESCE(SUM(CAST(isnan({c}) OR isinf({c}) AS BIGINT)), 0)" for c in _WCOLS) + " AS BIGINT) AS bad_values FROM weather_hourly"),
          "A13 P14")
def bad_value_count(spark, sf):
    from ..functions.sanitise import bad_value_count as bvc, sanitise
    return bvc(sanitise(B.weather_hourly(spark, sf)))
