"""Scoring queries: forecast features and clamp (M17, P25, P26), day summaries with labels
(A6, P28, T4), the current-index fallback (M18), the stage audit (A12), standard scaling (M9)
and model scoring (M17 with the trained model)."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import oracle as O
from ..catalog import register
from ..functions.aqi import aqi_category
from ..functions.labels import day_label, weekday_name
from ..functions.rounding import exact_mean, round_half_even
from ..operators.aggregates import stage_rows
from ..operators.ordering import first_n_dates, future_head
from ..plans.preprocess import FEATURE_COLS, PARITY, preprocess
from ..plans.scoring import clamp_forecast, current_index, forecast_features, score_forecast
from ..sources import bindings as B
from .composite import silver

W = O.with_ctes
D = O.D
SILVER = O.base_ctes(O.silver_cte())
NOW = "2024-01-30 23:00:00"
#: a time with three days of weather after it
SCORED_AT = "2024-01-27 12:00:00"


def _live_window(df, now=NOW):
    t = F.col("timestamp")
    n = F.lit(now).cast("timestamp_ntz")
    return df.filter((t > n - F.expr("INTERVAL 1 HOUR")) & (t <= n))


@register("current_index", W(*O.base_ctes(), f"""live AS (
  SELECT station, arg_max(aqi, timestamp) AS live FROM station_hourly
  WHERE aqi IS NOT NULL AND timestamp > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR
    AND timestamp <= TIMESTAMP '{NOW}' GROUP BY station)""", """st AS (
  SELECT station, arg_max(aqi, timestamp) AS stored FROM station_hourly WHERE aqi IS NOT NULL GROUP BY station)""",
    body=f"""
SELECT k.station, COALESCE(live, stored, {D(100.0)}) AS current_aqi,
       CASE WHEN live IS NOT NULL THEN 'live' WHEN stored IS NOT NULL THEN 'store' ELSE 'default' END AS source
FROM (SELECT DISTINCT station FROM station_hourly) k LEFT JOIN live l ON k.station = l.station
LEFT JOIN st s ON k.station = s.station"""), "M18 T2 F5")
def q_current(spark, sf):
    s = B.station_hourly(spark, sf)
    return current_index(_live_window(s), s, ["station"])


def _current_city(spark, sf, store):
    return current_index(_live_window(B.obs_hourly(spark, sf)), store)


_CUR_SQL = f"""cur AS (
  SELECT k.city, COALESCE(l.live, s.stored, {D(100.0)}) AS current_aqi
  FROM (SELECT city FROM obs_hourly UNION SELECT city FROM silver) k
  LEFT JOIN (SELECT city, arg_max(aqi, timestamp) AS live FROM obs_hourly WHERE aqi IS NOT NULL
             AND timestamp > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND timestamp <= TIMESTAMP '{NOW}' GROUP BY city) l
    ON k.city = l.city
  LEFT JOIN (SELECT city, arg_max(aqi, timestamp) AS stored FROM silver WHERE aqi IS NOT NULL GROUP BY city) s
    ON k.city = s.city)"""


def _clamp_sql(raw: str, last: str) -> str:
    lo, hi = f"({last} * {D(0.45)})", f"({last} * {D(1.55)})"
    clipped = f"(CASE WHEN {raw} < {lo} THEN {lo} WHEN {raw} > {hi} THEN {hi} ELSE {raw} END)"
    r = O.rhe(clipped, 1)
    return (f"(CASE WHEN {raw} IS NULL OR {last} IS NULL OR isnan({raw}) OR isnan({last}) THEN NULL "
            f"WHEN {r} > {D(500.0)} THEN {D(500.0)} WHEN {r} < {D(0.0)} THEN {D(0.0)} ELSE {r} END)")


def _range_sql(h: int) -> str:
    return f"""(SELECT f.city, f.timestamp,
    CASE WHEN COUNT(h.timestamp) = 0 THEN MAX(f.current_aqi) WHEN COUNT(h.aqi) = 0 THEN NULL
         ELSE CAST(SUM(CAST(h.aqi AS DECIMAL(30,6))) AS DOUBLE) / COUNT(h.aqi) END AS v
  FROM fc f LEFT JOIN silver h ON h.city = f.city
    AND h.timestamp BETWEEN f.timestamp - INTERVAL {h} HOUR AND f.timestamp - INTERVAL 1 HOUR
  GROUP BY f.city, f.timestamp)"""


_FC_SQL = f"""fc AS (
  SELECT w.city, w.timestamp, COALESCE(w.temp, {D(30.0)}) AS temp,
         COALESCE(w.feels_like, COALESCE(w.temp, {D(30.0)})) AS feels_like,
         COALESCE(w.humidity, {D(50.0)}) AS humidity, COALESCE(w.pressure, {D(1010.0)}) AS pressure,
         COALESCE(w.wind_speed, {D(3.0)}) AS wind_speed, COALESCE(w.wind_direction, {D(180.0)}) AS wind_direction,
         COALESCE(w.precipitation, {D(0.0)}) AS precipitation, COALESCE(w.weather_code, 0) AS weather_code,
         c.current_aqi
  FROM weather_hourly w LEFT JOIN cur c ON w.city = c.city)"""

_FEAT_SQL = f"""feat AS (
  SELECT f.*, CAST(hour(f.timestamp) AS INTEGER) AS hour, CAST(month(f.timestamp) AS INTEGER) AS month,
    CAST(isodow(f.timestamp) - 1 AS INTEGER) AS dayofweek, CAST(isodow(f.timestamp) - 1 >= 5 AS INTEGER) AS is_weekend,
    CAST(hour(f.timestamp) IN (7, 8, 9, 17, 18, 19) AS INTEGER) AS is_rush_hour,
    {O.cyc_sql('hour(f.timestamp)', 24, 'sin')} AS hour_sin, {O.cyc_sql('hour(f.timestamp)', 24, 'cos')} AS hour_cos,
    {O.cyc_sql('month(f.timestamp)', 12, 'sin')} AS month_sin, {O.cyc_sql('month(f.timestamp)', 12, 'cos')} AS month_cos,
    CASE WHEN month(f.timestamp) IN (12, 1, 2) THEN 0 WHEN month(f.timestamp) IN (3, 4, 5) THEN 1
         WHEN month(f.timestamp) IN (6, 7, 8) THEN 2 ELSE 3 END AS season,
    CAST(f.temp > 35 AS INTEGER) AS is_hot, CAST(f.temp < 10 AS INTEGER) AS is_cold,
    CAST(f.wind_speed < 2 AS INTEGER) AS is_calm_wind, CAST(f.wind_speed > 8 AS INTEGER) AS is_strong_wind,
    CAST(f.wind_speed < 2 AND f.humidity > 70 AS INTEGER) AS is_stagnant,
    f.temp * f.humidity AS temp_humidity, f.wind_speed * f.humidity AS wind_humidity,
    CASE WHEN h72.timestamp IS NULL THEN f.current_aqi ELSE h72.aqi END AS aqi_lag_72h,
    CASE WHEN h96.timestamp IS NULL THEN f.current_aqi ELSE h96.aqi END AS aqi_lag_96h,
    r72.v AS aqi_rolling_72h, r96.v AS aqi_rolling_96h
  FROM fc f
  ASOF LEFT JOIN silver h72 ON f.city = h72.city AND f.timestamp - INTERVAL 72 HOUR >= h72.timestamp
  ASOF LEFT JOIN silver h96 ON f.city = h96.city AND f.timestamp - INTERVAL 96 HOUR >= h96.timestamp
  JOIN {_range_sql(72)} r72 ON f.city = r72.city AND f.timestamp = r72.timestamp
  JOIN {_range_sql(96)} r96 ON f.city = r96.city AND f.timestamp = r96.timestamp)"""

_OUT = ["city", "timestamp", *FEATURE_COLS, "current_aqi", "predicted_aqi"]


@register("forecast_features", W(*SILVER, _CUR_SQL, _FC_SQL, _FEAT_SQL, body=f"""
SELECT {', '.join(c for c in _OUT if c != 'predicted_aqi')},
       {_clamp_sql('aqi_rolling_72h', 'current_aqi')} AS predicted_aqi FROM feat"""), "M17 P25 P26 J2 J3 W6 M18")
def q_forecast_features(spark, sf):
    store = silver(spark, sf)
    f = forecast_features(B.weather_hourly(spark, sf).drop("visibility"), store, _current_city(spark, sf, store))
    return f.withColumn("predicted_aqi", clamp_forecast(F.col("aqi_rolling_72h"), F.col("current_aqi"))).select(*_OUT)


@register("forecast_day_labels", W(*SILVER, _CUR_SQL, _FC_SQL, _FEAT_SQL, f"""pred AS (
  SELECT city, timestamp, {_clamp_sql('aqi_rolling_72h', 'current_aqi')} AS predicted_aqi,
         CAST(CAST(timestamp AS DATE) AS TIMESTAMP) AS date FROM feat WHERE timestamp > TIMESTAMP '2024-01-20 06:30:00')""",
    body=f"""
SELECT p.city, p.date, strftime(p.date, '%A') AS weekday, strftime(p.date, '%b %d') AS day_label,
       {O.emean('p.predicted_aqi')} AS avg_aqi, MIN(p.predicted_aqi) AS min_aqi, MAX(p.predicted_aqi) AS max_aqi,
       {O.category_sql(O.emean('p.predicted_aqi'))} AS category
FROM pred p JOIN (SELECT city, date FROM (SELECT city, date, ROW_NUMBER() OVER (PARTITION BY city ORDER BY date) AS rn
                  FROM (SELECT DISTINCT city, date FROM pred) d) x WHERE rn <= 3) k ON p.city = k.city AND p.date = k.date
GROUP BY p.city, p.date"""), "A6 P28 T4 P25")
def q_day_labels(spark, sf):
    store = silver(spark, sf)
    f = forecast_features(B.weather_hourly(spark, sf).drop("visibility"), store, _current_city(spark, sf, store))
    p = f.select("city", "timestamp", clamp_forecast(F.col("aqi_rolling_72h"), F.col("current_aqi")).alias("predicted_aqi"),
                 F.to_date("timestamp").cast("timestamp_ntz").alias("date")) \
        .filter(F.col("timestamp") > F.lit("2024-01-20 06:30:00").cast("timestamp_ntz"))
    first = first_n_dates(p, ["city"], "date", 3)
    g = p.join(first, ["city", "date"], "left_semi").groupBy("city", "date").agg(
        exact_mean(F.col("predicted_aqi")).alias("avg_aqi"), F.min("predicted_aqi").alias("min_aqi"),
        F.max("predicted_aqi").alias("max_aqi"))
    return g.select("city", "date", weekday_name(F.col("date")).alias("weekday"), day_label(F.col("date")).alias("day_label"),
                    "avg_aqi", "min_aqi", "max_aqi", aqi_category(F.col("avg_aqi")).alias("category"))


_STAGES = [("input", "silver"), ("dedup", "gold_s0"), ("outliers_aqi", "gold_f1"), ("outliers_pm25", "gold_f2"),
           ("outliers_pm10", "gold_f3"), ("final", "gold")]


@register("stage_audit", W(*SILVER, *O.preprocess_ctes(), body=" UNION ALL ".join(
    f"SELECT COUNT(*) AS rows, '{s}' AS stage FROM {t}" for s, t in _STAGES)), "A12")
def q_audit(spark, sf):
    audit: list = []
    preprocess(silver(spark, sf), audit=audit, **PARITY).write.format("noop").mode("overwrite").save()
    return stage_rows(spark, audit)


def _standard_sql():
    from .model_queries import GOLD, _SPLIT
    out = []
    for c in FEATURE_COLS:
        x = f"CAST({c} AS DOUBLE)"
        of = f"(SELECT {{}}(CAST({c} AS DOUBLE)) FROM split WHERE rn <= cut)"
        std = f"(CASE WHEN {of.format('stddev_pop')} = 0 THEN {D(1.0)} ELSE {of.format('stddev_pop')} END)"
        out.append(f"{O.rhe(f'({x} - {of.format("avg")}) / {std}', 6)} AS {c}")
    return W(*GOLD, _SPLIT, body=f"SELECT city, timestamp, {', '.join(out)} FROM gold")


@register("standard_scale", _standard_sql(), "M9 A11")
def q_standard(spark, sf):
    from ..models.prep import chronological_split, standard_scale
    from .model_queries import gold
    g = gold(spark, sf)
    tr, _ = chronological_split(g, 0.8)
    out = standard_scale(tr, g, FEATURE_COLS)
    return out.select("city", "timestamp", *[round_half_even(F.col(c), 6).alias(c) for c in FEATURE_COLS])


@register("score_forecast", None, "M17 P25 M8")
def q_score(spark, sf, now=SCORED_AT):
    from ..models.train import best_model, results_of
    from .model_queries import trained_models
    _, _, trained = trained_models(spark, sf)
    best = best_model(results_of(trained)).first()["model"]
    model = {t.name: t for t in trained}[best].model
    store = silver(spark, sf)
    # the weather table's last days play the forecast: what lies after ``now``, within 72 hours
    now = F.lit(now).cast("timestamp_ntz")
    ahead = future_head(B.weather_hourly(spark, sf).drop("visibility"), now, n=72)
    known = store.filter(F.col("timestamp") <= now)
    f = forecast_features(ahead, known, current_index(_live_window(B.obs_hourly(spark, sf), SCORED_AT), known))
    return score_forecast(model, f).withColumn("model", F.lit(best))


# Coefficients of the linear model whose contributions the report explains.
_COEFFICIENTS = {"temp": 0.75, "humidity": -0.25, "pressure": 0.125, "wind_speed": -2.5, "wind_direction": 0.0625}


def _report_sql():
    from ..functions.labels import FEATURE_DISPLAY_NAMES
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(abs({D(w)} * ({c} - (SELECT avg({c}) FROM silver)))) AS v FROM silver WHERE {c} IS NOT NULL"
        for c, w in _COEFFICIENTS.items())
    name = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURE_DISPLAY_NAMES.items()) + \
        " WHEN 'pressure' THEN 'Pressure' WHEN 'wind_direction' THEN 'Wind Direction' END"
    return W(*SILVER, f"imp AS (SELECT feature, {O.rhe('v', 6)} AS shap_value FROM ({parts}) u)", body=f"""
SELECT feature, shap_value, CAST(floor(shap_value / max(shap_value) OVER () * 20) AS INTEGER) AS bar, {name} AS display_name
FROM imp ORDER BY shap_value DESC, feature LIMIT 3""")


@register("importance_report", _report_sql(), "A15 T5 P30 P28 K7 S11")
def q_importance_report(spark, sf):
    """Mean absolute contributions of a linear model, saved and read back, the three largest."""
    from ..functions.labels import feature_display_name
    from ..operators.aggregates import importance_share, mean_abs_contribution
    from ..operators.ordering import top_k
    from ..session import scratch_path, staged_table
    from ..sinks.files import save_importance
    from ..sources.payloads import read_importance
    names = list(_COEFFICIENTS)
    rows = staged_table(silver(spark, sf).select(*names), "explained")
    mean = rows.agg(*[F.avg(c).alias(c) for c in names]).first()  # one number per feature
    contrib = rows.select(F.array(*[F.lit(w) * (F.col(c) - F.lit(mean[c])) for c, w in _COEFFICIENTS.items()]).alias("contrib"))
    imp = mean_abs_contribution(contrib, names).withColumn("shap_value", round_half_even(F.col("shap_value"), 6))
    path = scratch_path(spark, "importance")
    save_importance(imp, path)
    top = top_k(importance_share(read_importance(spark, path)), "shap_value", 3, tiebreak=["feature"])
    return top.withColumn("display_name", feature_display_name(F.col("feature")))
