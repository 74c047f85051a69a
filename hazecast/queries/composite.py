"""Composite plans: measured history (M1), estimated history (M2), live row (M3),
preprocessing (M4) and model-input selection (P20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ..catalog import register
from ..plans.history import build_history, engineer_live, estimate_history
from ..plans.preprocess import PARITY, FEATURE_COLS, preprocess, select_features
from ..sources import bindings as B

W = O.with_ctes
C = O.base_ctes


def silver(spark, sf, method="halo"):
    return build_history(B.weather_hourly(spark, sf), B.params_hourly(spark, sf), gap_policy="reference", method=method)


@register("build_history", W(*C(O.silver_cte()), body="SELECT * FROM silver"), "M1 J1 P1 P5 P6 P7 W3 F3 P18")
def q_build_history(spark, sf):
    return silver(spark, sf)


_PRE_COLS = O.PRE_OUT + O.MODEL_FEATURES


@register("preprocess_features", W(*C(O.silver_cte(), *O.preprocess_ctes()),
                                   body=f"SELECT {', '.join(_PRE_COLS)} FROM gold"),
          "M4 W5 F1 A2 J4 W4 P5-P12 W1 W2 F3")
def q_preprocess(spark, sf):
    return preprocess(silver(spark, sf), **PARITY).select(*_PRE_COLS)


@register("model_inputs", W(*C(O.silver_cte(), *O.preprocess_ctes()),
                            body=f"SELECT timestamp, aqi, {', '.join(O.MODEL_FEATURES)} FROM gold"), "P20")
def q_model_inputs(spark, sf):
    return select_features(preprocess(silver(spark, sf), **PARITY), ["timestamp", "aqi"])


def _reference_row(spark, sf):
    """Latest station reading per city (the 'current' reference for estimators)."""
    p = B.params_hourly(spark, sf)
    h = B.obs_hourly(spark, sf)
    last = p.groupBy("city").agg(F.max_by(F.struct("pm25", "pm10", "no2", "o3", "co", "so2"), "timestamp").alias("r"))
    aq = h.groupBy("city").agg(F.max_by("aqi", "timestamp").alias("aqi_now"))
    return last.select("city", "r.*").join(aq, "city")


_REF_SQL = """ref AS (
  SELECT p.city, p.pm25, p.pm10, p.no2, p.o3, p.co, p.so2,
         (SELECT arg_max(aqi, timestamp) FROM obs_hourly) AS aqi_now
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM params_hourly) p
  WHERE rn = 1)"""


def _est_sql(version: str) -> str:
    def fac(col, default):
        return f"COALESCE({col}, {O.D(default)})"
    from ..functions.estimate import HOURLY_FACTOR, MONTHLY_AQI_BASELINE, MONTHLY_PM25_BASELINE, SEASONAL_FACTOR

    def case(mapping, x, default=None):
        body = " ".join(f"WHEN {x} = {k} THEN {O.D(float(v))}" for k, v in mapping.items())
        return f"(CASE {body} ELSE {O.D(default) if default is not None else 'NULL'} END)"
    h, w, t, r = fac("w.humidity", 50.0), fac("w.wind_speed", 3.0), fac("w.temp", 25.0), fac("w.precipitation", 0.0)
    if version == "current":
        base = f"CAST(ref.aqi_now AS DOUBLE) * {case(SEASONAL_FACTOR, 'month(w.timestamp)', 1.0)}"
    else:
        base = case(MONTHLY_AQI_BASELINE, "month(w.timestamp)")
    prod = (f"{base} * {case(HOURLY_FACTOR, 'hour(w.timestamp)', 1.0)}"
            f" * ({O.D(1.0)} + ({h} - {O.D(50.0)}) * {O.D(0.004)})"
            f" * greatest({O.D(0.5)}, {O.D(1.0)} - {w} * {O.D(0.06)})"
            f" * greatest({O.D(0.4)}, {O.D(1.0)} - {r} * {O.D(0.3)})"
            f" * ({O.D(1.0)} + greatest({O.D(0.0)}, {t} - {O.D(35.0)}) * {O.D(0.01)})")
    est = f"greatest({O.D(10.0)}, {O.rhe(prod, 1)})"
    if version == "current":
        scale = f"(CASE WHEN ref.aqi_now > 0 THEN e.est / ref.aqi_now ELSE {O.D(1.0)} END)"
        pol = ", ".join(f"CASE WHEN e.{c} IS NOT NULL AND e.{c} <> 0 THEN {O.rhe(f'e.{c} * {scale}', 1)} END AS {c}"
                        for c in ["pm25", "pm10", "no2", "o3", "co", "so2"])
    else:
        mb = case(MONTHLY_AQI_BASELINE, "month(e.timestamp)")
        pm = case(MONTHLY_PM25_BASELINE, "month(e.timestamp)")
        scale = f"(CASE WHEN {mb} > 0 THEN e.est / {mb} ELSE {O.D(1.0)} END)"
        pol = (f"{O.rhe(f'{pm} * {scale}', 1)} AS pm25, {O.rhe(f'{pm} * {scale} * {O.D(1.4)}', 1)} AS pm10, " +
               ", ".join(f"CASE WHEN e.{c} IS NOT NULL AND ref.aqi_now IS NOT NULL AND ref.aqi_now <> 0 THEN "
                         f"{O.rhe(f'e.{c} / ref.aqi_now * e.est', 1)} END AS {c}" for c in ["no2", "o3", "co", "so2"]))
    return f"""est_{version} AS (
  SELECT e.city, e.timestamp, e.est AS aqi, {pol}, {O.cal_sql('e.timestamp')},
         {O.rhe("COALESCE(e.est - LAG(e.est) OVER (PARTITION BY e.city ORDER BY e.timestamp), " + O.D(0.0) + ")", 2)}
           AS aqi_change_rate
  FROM (SELECT w.city, w.timestamp, {est} AS est, ref.pm25, ref.pm10, ref.no2, ref.o3, ref.co, ref.so2
        FROM weather_hourly w LEFT JOIN ref ON w.city = ref.city) e
  LEFT JOIN ref ON e.city = ref.city)"""


_EST_COLS = ["city", "timestamp", "aqi", "pm25", "pm10", "no2", "o3", "co", "so2", "hour", "day", "month",
             "dayofweek", "is_weekend", "is_rush_hour", "aqi_change_rate"]


@register("estimate_history_current", W(*C(_REF_SQL, _est_sql("current")),
                                        body=f"SELECT {', '.join(_EST_COLS)} FROM est_current"),
          "M2 P21 P23 J5 W3")
def q_estimate_current(spark, sf):
    return estimate_history(B.weather_hourly(spark, sf), _reference_row(spark, sf), "current").select(*_EST_COLS)


@register("estimate_history_monthly", W(*C(_REF_SQL, _est_sql("monthly")),
                                        body=f"SELECT {', '.join(_EST_COLS)} FROM est_monthly"),
          "M2 P22 P24 J6 W3")
def q_estimate_monthly(spark, sf):
    return estimate_history(B.weather_hourly(spark, sf), _reference_row(spark, sf), "monthly").select(*_EST_COLS)


@register("engineer_live", W(*C(O.silver_cte()), body=f"""
SELECT o.city, o.timestamp, o.aqi, w.temp, w.humidity, {O.cal_sql('o.timestamp')},
  CASE WHEN l.last_aqi IS NULL THEN {O.D(0.0)} ELSE {O.rhe('o.aqi - l.last_aqi', 2)} END AS aqi_change_rate
FROM obs_hourly o JOIN weather_hourly w ON o.city = w.city AND o.timestamp = w.timestamp
LEFT JOIN (SELECT city, arg_max(aqi, timestamp) AS last_aqi FROM silver WHERE aqi IS NOT NULL GROUP BY city) l
  ON o.city = l.city"""), "M3 T2 J5")
def q_engineer_live(spark, sf):
    live = B.obs_hourly(spark, sf).select("city", "timestamp", "aqi")
    w = B.weather_hourly(spark, sf).select("city", "timestamp", "temp", "humidity")
    out = engineer_live(live, w, silver(spark, sf))
    return out.select("city", "timestamp", "aqi", "temp", "humidity", "hour", "day", "month", "dayofweek",
                      "is_weekend", "is_rush_hour", "aqi_change_rate")


_EST_TABLE = ("est_table AS (SELECT e.city, e.timestamp, e.aqi, e.pm25, e.pm10, e.no2, e.o3, e.co, e.so2, w.temp, w.feels_like, w.humidity, "
              "w.pressure, w.wind_speed, w.wind_direction, w.visibility, w.precipitation, w.weather_code, CAST(NULL AS VARCHAR) AS weather, "
              "e.hour, e.day, e.month, e.dayofweek, e.is_weekend, e.is_rush_hour, e.aqi_change_rate, CAST(NULL AS BIGINT) AS ingest_seq "
              "FROM est_monthly e JOIN weather_hourly w ON e.city = w.city AND e.timestamp = w.timestamp)")


@register("preprocess_estimated", W(*C(_REF_SQL, _est_sql("monthly")), _EST_TABLE,
                                    *O.preprocess_ctes("est_table", "egold", ("pm25", "pm10")),
                                    body="SELECT city, timestamp, aqi, pm25, pm10, temp, aqi_lag_72h, aqi_lag_96h, aqi_rolling_72h FROM egold"),
          "M2 M4 W5")
def q_preprocess_estimated(spark, sf):
    """Estimated history, whose rows have no ingest order, through the preprocessing plan."""
    est = estimate_history(B.weather_hourly(spark, sf), _reference_row(spark, sf), "monthly")
    return preprocess(est, **PARITY).select("city", "timestamp", "aqi", "pm25", "pm10", "temp", "aqi_lag_72h", "aqi_lag_96h", "aqi_rolling_72h")
