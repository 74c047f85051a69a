"""Window, join, imputation and quantile queries (W1-W6, J1-J6, A2, F1, T1-T6, U1-U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ..catalog import register
from ..functions.aqi import aqi_category, pm25_to_aqi
from ..functions.estimate import MONTHLY_AQI_BASELINE, SEASONAL_FACTOR, lookup
from ..operators import ordering as T
from ..operators.filters import iqr_filter
from ..operators.joins import align_hourly, history_features, with_reference_row
from ..operators.knn import knn_impute
from ..operators.quantiles import exact_quantiles
from ..operators.setops import append_rows, concat_sources
from ..operators.windows import fill_forward_backward, series_row_features
from ..plans.preprocess import keep_last
from ..sources import bindings as B

W = O.with_ctes
C = O.base_ctes

PARAMS_AQI = f"""params_aqi AS (
  SELECT city, timestamp, pm25, {O.aqi_sql('pm25')} AS aqi, ingest_seq FROM params_hourly)"""


def params_aqi(spark, sf):
    p = B.params_hourly(spark, sf)
    return p.select("city", "timestamp", "pm25", pm25_to_aqi(F.col("pm25"), 0, "reference").alias("aqi"), "ingest_seq")


# ---------------------------------------------------------------- W1-W3
@register("lag_rows", W(*C(PARAMS_AQI), body="""
SELECT city, timestamp, aqi, LAG(aqi, 72) OVER (PARTITION BY city ORDER BY timestamp) AS aqi_lag_72h,
       LAG(aqi, 96) OVER (PARTITION BY city ORDER BY timestamp) AS aqi_lag_96h FROM params_aqi"""), "W1")
def lag_rows(spark, sf):
    return series_row_features(params_aqi(spark, sf), ["city"], "timestamp", ["timestamp"], "aqi",
                               lags=(72, 96)).select("city", "timestamp", "aqi", "aqi_lag_72h", "aqi_lag_96h")


@register("rolling_rows", W(*C(PARAMS_AQI), body=f"""
SELECT city, timestamp, aqi, {O.rolling_sql('aqi', 72)} AS aqi_rolling_72h, {O.rolling_sql('aqi', 96)} AS aqi_rolling_96h,
       {O.rolling_sql('aqi', 72, include_current=False)} AS aqi_prior_72h FROM params_aqi"""), "W2")
def rolling_rows(spark, sf):
    p = params_aqi(spark, sf)
    a = series_row_features(p, ["city"], "timestamp", ["timestamp"], "aqi", rolls=(72, 96))
    b = series_row_features(p, ["city"], "timestamp", ["timestamp"], "aqi", rolls=(72,), include_current=False) \
        .select("city", "timestamp", F.col("aqi_rolling_72h").alias("aqi_prior_72h"))
    return a.join(b, ["city", "timestamp"]).select("city", "timestamp", "aqi", "aqi_rolling_72h",
                                                  "aqi_rolling_96h", "aqi_prior_72h")


@register("station_lags", W(*C(), body=f"""
SELECT station, timestamp, aqi, LAG(aqi, 72) OVER (PARTITION BY station ORDER BY timestamp) AS aqi_lag_72h,
       {O.rolling_sql('aqi', 72, keys='station')} AS aqi_rolling_72h,
       {O.rhe("COALESCE(aqi - LAG(aqi) OVER (PARTITION BY station ORDER BY timestamp), " + O.D(0.0) + ")", 2)} AS change
FROM station_hourly"""), "W1 W2 W3 (many keys)")
def station_lags(spark, sf):
    s = B.station_hourly(spark, sf)
    return series_row_features(s, ["station"], "timestamp", ["timestamp"], "aqi", lags=(72,), rolls=(72,),
                               change_rate="change", block_rows=256) \
        .select("station", "timestamp", "aqi", "aqi_lag_72h", "aqi_rolling_72h", "change")


@register("change_rate", W(*C(PARAMS_AQI), body=f"""
SELECT city, timestamp, aqi,
  {O.rhe("COALESCE(aqi - LAG(aqi) OVER (PARTITION BY city ORDER BY timestamp), " + O.D(0.0) + ")", 2)} AS aqi_change_rate
FROM params_aqi"""), "W3")
def change_rate(spark, sf):
    return series_row_features(params_aqi(spark, sf), ["city"], "timestamp", ["timestamp"], "aqi",
                               change_rate="aqi_change_rate", block_rows=64) \
        .select("city", "timestamp", "aqi", "aqi_change_rate")


# ---------------------------------------------------------------- W4, W5, W6
_FILL = ["temp", "wind_speed", "pressure", "precipitation"]


@register("fill_forward_backward", W(*C(), body=f"""
SELECT city, timestamp, {", ".join(O.ffill_sql(c) + " AS " + c for c in _FILL)} FROM weather_hourly"""), "W4")
def fill_fb(spark, sf):
    w = B.weather_hourly(spark, sf).select("city", "timestamp", *_FILL)
    return fill_forward_backward(w, ["city"], "timestamp", ["timestamp"], _FILL)


@register("keep_last", W(*C(), body="""
SELECT city, timestamp, station, sensor, pm25_raw, ingest_seq FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY city, timestamp ORDER BY ingest_seq DESC) AS rn FROM dup_hourly) d
WHERE rn = 1"""), "W5 K2")
def q_keep_last(spark, sf):
    d = B.dup_hourly(spark, sf).select("city", "timestamp", "station", "sensor", "pm25_raw", "ingest_seq")
    return keep_last(d, ["city", "timestamp"])


def _range_sql(h: int, default: str) -> str:
    return f"""(SELECT p.city, p.timestamp,
    CASE WHEN COUNT(h.timestamp) = 0 THEN {default} WHEN COUNT(h.aqi) = 0 THEN NULL
         ELSE CAST(SUM(CAST(h.aqi AS DECIMAL(30,6))) AS DOUBLE) / COUNT(h.aqi) END AS v
  FROM probes p LEFT JOIN params_aqi h ON h.city = p.city
    AND h.timestamp BETWEEN p.timestamp - INTERVAL {h} HOUR AND p.timestamp - INTERVAL 1 HOUR
  GROUP BY p.city, p.timestamp)"""


_LAST = """last_aqi AS (SELECT city, arg_max(aqi, timestamp) AS last_aqi FROM params_aqi WHERE aqi IS NOT NULL GROUP BY city)"""
_PROBES = """probes AS (SELECT w.city, w.timestamp, w.temp FROM weather_hourly w)"""


@register("rolling_time", W(*C(PARAMS_AQI, _LAST, "probes AS (SELECT city, timestamp FROM params_aqi)"), body=f"""
SELECT r72.city, r72.timestamp, r72.v AS aqi_roll_72h, r96.v AS aqi_roll_96h
FROM {_range_sql(72, 'NULL')} r72 JOIN {_range_sql(96, 'NULL')} r96
  ON r72.city = r96.city AND r72.timestamp = r96.timestamp"""), "W6")
def rolling_time(spark, sf):
    p = params_aqi(spark, sf)
    out = history_features(p.select("city", "timestamp"), p, ["city"], "timestamp", "aqi", rolls=(72, 96))
    return out.select("city", "timestamp", F.col("aqi_rolling_72h").alias("aqi_roll_72h"),
                      F.col("aqi_rolling_96h").alias("aqi_roll_96h"))


def _last_aqi(spark, sf):
    p = params_aqi(spark, sf)
    return p.filter(F.col("aqi").isNotNull()).groupBy("city").agg(F.max_by("aqi", "timestamp").alias("last_aqi"))


@register("asof_lag", W(*C(PARAMS_AQI, _LAST, _PROBES), body="""
SELECT p.city, p.timestamp, p.temp,
  CASE WHEN h72.timestamp IS NULL THEN l.last_aqi ELSE h72.aqi END AS aqi_lag_72h,
  CASE WHEN h96.timestamp IS NULL THEN l.last_aqi ELSE h96.aqi END AS aqi_lag_96h
FROM probes p
ASOF LEFT JOIN params_aqi h72 ON p.city = h72.city AND p.timestamp - INTERVAL 72 HOUR >= h72.timestamp
ASOF LEFT JOIN params_aqi h96 ON p.city = h96.city AND p.timestamp - INTERVAL 96 HOUR >= h96.timestamp
LEFT JOIN last_aqi l ON p.city = l.city"""), "J2 W6")
def asof_lag(spark, sf):
    hist = params_aqi(spark, sf)
    probes = B.weather_hourly(spark, sf).select("city", "timestamp", "temp").join(_last_aqi(spark, sf), "city", "left")
    out = history_features(probes, hist, ["city"], "timestamp", "aqi", lags=(72, 96), default="last_aqi")
    return out.select("city", "timestamp", "temp", "aqi_lag_72h", "aqi_lag_96h")


@register("range_mean", W(*C(PARAMS_AQI, _LAST, _PROBES), body=f"""
SELECT r72.city, r72.timestamp, r72.v AS aqi_rolling_72h, r96.v AS aqi_rolling_96h
FROM {_range_sql(72, 'l.last_aqi')} r72 JOIN {_range_sql(96, 'l.last_aqi')} r96
  ON r72.city = r96.city AND r72.timestamp = r96.timestamp""".replace(
    "FROM probes p LEFT JOIN params_aqi h", "FROM probes p LEFT JOIN last_aqi l ON l.city = p.city LEFT JOIN params_aqi h")
    .replace("GROUP BY p.city, p.timestamp", "GROUP BY p.city, p.timestamp, l.last_aqi")), "J3 W6")
def q_range_mean(spark, sf):
    hist = params_aqi(spark, sf)
    probes = B.weather_hourly(spark, sf).select("city", "timestamp").join(_last_aqi(spark, sf), "city", "left")
    out = history_features(probes, hist, ["city"], "timestamp", "aqi", rolls=(72, 96), default="last_aqi")
    return out.select("city", "timestamp", "aqi_rolling_72h", "aqi_rolling_96h")


# ---------------------------------------------------------------- J1, J4, J5, J6
@register("align_hourly", W(*C(), body="""
SELECT w.city, w.timestamp, w.temp, w.humidity, p.pm25, p.pm10
FROM weather_hourly w JOIN params_hourly p ON w.city = p.city AND w.timestamp = p.timestamp"""), "J1")
def q_align(spark, sf):
    return align_hourly(B.weather_hourly(spark, sf), B.params_hourly(spark, sf)) \
        .select("city", "timestamp", "temp", "humidity", "pm25", "pm10")


_KNN_COLS = ["pm25", "pm10", "no2", "o3", "co"]


@register("knn_impute", W(*C("knn_src AS (SELECT city, timestamp, " + ", ".join(_KNN_COLS) + " FROM params_hourly)",
                             O.knn_cte("knn_out", "knn_src", _KNN_COLS, ["city", "timestamp", *_KNN_COLS])),
                          body="SELECT * FROM knn_out"), "J4")
def q_knn(spark, sf):
    p = B.params_hourly(spark, sf).select("city", "timestamp", *_KNN_COLS)
    return knn_impute(p, ["city"], "timestamp", _KNN_COLS)


@register("reference_row", W(*C(), body="""
SELECT w.city, w.timestamp, w.humidity, r.aqi_now, r.pm25_now FROM weather_hourly w
LEFT JOIN (SELECT city, arg_max(aqi, timestamp) AS aqi_now, arg_max(pm25, timestamp) AS pm25_now
           FROM obs_hourly GROUP BY city) r ON w.city = r.city"""), "J5 T2")
def q_reference_row(spark, sf):
    h = B.obs_hourly(spark, sf)
    ref = T.latest_per_key(h, ["city"], "timestamp", ["aqi", "pm25"]).select(
        "city", F.col("aqi").alias("aqi_now"), F.col("pm25").alias("pm25_now"))
    return with_reference_row(B.weather_hourly(spark, sf).select("city", "timestamp", "humidity"), ref)


@register("month_lookup", W(*C(), body="SELECT date, month(date) AS month, " + "(CASE " + " ".join(
    f"WHEN month(date) = {k} THEN {O.D(float(v))}" for k, v in MONTHLY_AQI_BASELINE.items()) + " END) AS baseline, (CASE "
    + " ".join(f"WHEN month(date) = {k} THEN {O.D(float(v))}" for k, v in SEASONAL_FACTOR.items())
    + " END) AS seasonal, aqi FROM daily_long"), "J6")
def q_month_lookup(spark, sf):
    d = B.daily_long(spark, sf)
    m = F.month("date")
    return d.select("date", m.alias("month"), lookup(MONTHLY_AQI_BASELINE, m).alias("baseline"),
                    lookup(SEASONAL_FACTOR, m).alias("seasonal"), "aqi")


# ---------------------------------------------------------------- A2, F1
@register("quartiles", W(*C(O.quantile_cte("qs", "obs_raw", ["station"], "pm25_raw", [0.25, 0.5, 0.75],
                                           ["q25", "q50", "q75"])), body="SELECT station, n, q25, q50, q75 FROM qs"),
          "A2 A10")
def q_quartiles(spark, sf):
    r = B.obs_raw(spark, sf)
    return exact_quantiles(r, ["station"], "pm25_raw", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])


@register("iqr_filter", W(*C("raw AS (SELECT station AS city, ingest_seq, pm25_raw FROM obs_raw)",
                             O.iqr_filter_cte("kept", "raw", "pm25_raw", 3, ["city", "ingest_seq", "pm25_raw"])),
                          body="SELECT city, ingest_seq, pm25_raw FROM kept"), "F1 A2")
def q_iqr(spark, sf):
    r = B.obs_raw(spark, sf).select(F.col("station").alias("city"), "ingest_seq", "pm25_raw")
    return iqr_filter(r, ["city"], "pm25_raw", k=3)


# ---------------------------------------------------------------- T1-T5, F4, A6
@register("latest_row", W(*C(), body="""
SELECT city, timestamp, aqi, pm25 FROM obs_hourly ORDER BY timestamp DESC LIMIT 1"""), "T2 S12")
def q_latest(spark, sf):
    return T.latest_row(B.obs_hourly(spark, sf), "timestamp", ["city", "timestamp", "aqi", "pm25"])


_NOW = "TIMESTAMP '2024-01-20 06:30:00'"


@register("future_horizon", W(*C(), body=f"""
SELECT city, timestamp, temp FROM (
  SELECT city, timestamp, temp, ROW_NUMBER() OVER (PARTITION BY city ORDER BY timestamp) AS rn
  FROM weather_hourly WHERE timestamp > {_NOW}) f WHERE rn <= 72"""), "F4 T3")
def q_future(spark, sf):
    w = B.weather_hourly(spark, sf).select("city", "timestamp", "temp")
    return T.future_head(w, F.lit("2024-01-20 06:30:00").cast("timestamp_ntz"), n=72, by="rows")


@register("forecast_day_summary", W(*C(), body=f"""
SELECT o.city, CAST(CAST(o.timestamp AS DATE) AS TIMESTAMP) AS date, {O.emean('o.aqi')} AS avg_aqi,
  MIN(o.aqi) AS min_aqi, MAX(o.aqi) AS max_aqi, {O.category_sql(O.emean('o.aqi'))} AS category
FROM obs_hourly o JOIN (
  SELECT city, d FROM (SELECT city, d, ROW_NUMBER() OVER (PARTITION BY city ORDER BY d) AS rn
    FROM (SELECT DISTINCT city, CAST(CAST(timestamp AS DATE) AS TIMESTAMP) AS d FROM obs_hourly WHERE timestamp > {_NOW}) x) y
  WHERE rn <= 3) f ON o.city = f.city AND CAST(CAST(o.timestamp AS DATE) AS TIMESTAMP) = f.d
WHERE o.timestamp > {_NOW}
GROUP BY o.city, CAST(CAST(o.timestamp AS DATE) AS TIMESTAMP)"""), "A6 T4")
def q_day_summary(spark, sf):
    from ..operators.aggregates import forecast_day_summary
    h = B.obs_hourly(spark, sf).filter(F.col("timestamp") > F.lit("2024-01-20 06:30:00").cast("timestamp_ntz"))
    return forecast_day_summary(h, value="aqi")


@register("sort_by_time", W(*C(), body="SELECT city, timestamp, aqi FROM obs_hourly ORDER BY timestamp"), "T1")
def q_sort(spark, sf):
    return T.sort_by_time(B.obs_hourly(spark, sf).select("city", "timestamp", "aqi"))


# ---------------------------------------------------------------- U1, U2
@register("append_rows", W(*C(), body="""
SELECT city, timestamp, aqi, pm25, CAST(NULL AS DOUBLE) AS temp FROM obs_hourly
UNION ALL SELECT city, timestamp, CAST(NULL AS DOUBLE) AS aqi, CAST(NULL AS DOUBLE) AS pm25, temp FROM weather_hourly"""),
          "U1")
def q_append(spark, sf):
    a = B.obs_hourly(spark, sf).select("city", "timestamp", "aqi", "pm25")
    b = B.weather_hourly(spark, sf).select("city", "timestamp", "temp")
    return append_rows(a, b)


@register("concat_locations", W(*C(), body=f"""
SELECT timestamp, {O.emean('pm25_raw', 9)} AS pm25, COUNT(*) AS n_readings FROM (
  SELECT timestamp, pm25_raw FROM dup_hourly WHERE station IN ('click', 'error', 'purchase', 'signup', 'view')) u
GROUP BY timestamp"""), "U2 A1")
def q_concat(spark, sf):
    d = B.dup_hourly(spark, sf)
    parts = [d.filter(F.col("station") == s).select("timestamp", "pm25_raw") for s in B.POLLUTANT_OF_STATION]
    from ..operators.aggregates import mean_per_timestamp
    return mean_per_timestamp(concat_sources(parts), ["timestamp"], "pm25_raw", "pm25")
