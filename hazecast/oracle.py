"""Independent DuckDB SQL for the correctness gate.

Plain ANSI-style SQL over the driver's pre-registered views.  Shared pieces
(bindings, the index CASE) are CTE text.  Float literals are written as
CAST('...' AS DOUBLE) so both engines see the same binary constants; means are
decimal sums divided once, and half-even rounding scales in binary.
"""

from __future__ import annotations

from .functions.aqi import BEYOND_SCALE, CATEGORY4_BANDS, CATEGORY_BANDS, PM25_BREAKPOINTS, TOP_CATEGORY, \
    TOP_CATEGORY4, band_slope
from .plans.history import FEATURE_TABLE_COLS
from .plans.preprocess import FEATURE_COLS
from .sources.bindings import DEFAULT_CITY, POLLUTANT_OF_STATION


def D(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def rhe(expr: str, digits: int) -> str:
    """Half-even rounding scaled in binary; '+ 0.0' turns -0.0 into 0.0 (Spark's bround never yields -0.0)."""
    if digits == 0:
        return f"(round_even({expr}, 0) + {D(0.0)})"
    s = D(10.0 ** digits)
    return f"((round_even(({expr}) * {s}, 0) / {s}) + {D(0.0)})"


def emean(expr: str, scale: int = 6, where: str | None = None) -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return (f"(CAST(SUM(CAST({expr} AS DECIMAL(18,{scale}))){f} AS DOUBLE)"
            f" / NULLIF(COUNT({expr}){f}, 0))")


def aqi_sql(x: str, digits: int = 0, policy: str = "reference") -> str:
    xv = f"(floor(({x}) * {D(10.0)}) / {D(10.0)})" if policy == "truncate" else f"({x})"
    parts = []
    for band in PM25_BREAKPOINTS:
        c_lo, c_hi, i_lo, _ = band
        val = rhe(f"{D(band_slope(band))} * ({xv} - {D(c_lo)}) + {D(float(i_lo))}", digits)
        parts.append(f"WHEN {xv} >= {D(c_lo)} AND {xv} <= {D(c_hi)} THEN {val}")
    return (f"(CASE WHEN ({x}) IS NULL OR isnan(({x})::DOUBLE) OR ({x}) < 0 THEN NULL "
            + " ".join(parts) + f" ELSE {D(BEYOND_SCALE)} END)")


def category_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} <= {u} THEN '{n}'" for u, n, _ in CATEGORY_BANDS)
    return f"(CASE WHEN {x} IS NULL THEN NULL {parts} ELSE '{TOP_CATEGORY[0]}' END)"


def color_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} <= {u} THEN '{c}'" for u, _, c in CATEGORY_BANDS)
    return f"(CASE WHEN {x} IS NULL THEN NULL {parts} ELSE '{TOP_CATEGORY[1]}' END)"


def category4_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} <= {u} THEN '{n}'" for u, n in CATEGORY4_BANDS)
    return f"(CASE WHEN {x} IS NULL THEN NULL {parts} ELSE '{TOP_CATEGORY4}' END)"


CITY = f"'{DEFAULT_CITY}'"

OBS_RAW = f"""obs_raw AS (
  SELECT {CITY} AS city, ts, event_type AS station, user_id AS sensor, value AS pm25_raw,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id AS ingest_seq
  FROM events)"""

DUP_HOURLY = """dup_hourly AS (
  SELECT city, date_trunc('hour', ts) AS timestamp, station, sensor, pm25_raw, k, ingest_seq FROM obs_raw)"""


def obs_hourly_cte(digits: int = 0, policy: str = "reference", name: str = "obs_hourly") -> str:
    return f"""{name} AS (
  SELECT city, timestamp, pm25, n_readings, {aqi_sql('pm25', digits, policy)} AS aqi FROM (
    SELECT city, timestamp, {emean('pm25_raw', 9)} AS pm25, COUNT(pm25_raw) AS n_readings
    FROM dup_hourly GROUP BY city, timestamp) t)"""


PARAMS_HOURLY = "params_hourly AS (\n  SELECT city, timestamp, " + ", ".join(
    f"{emean('pm25_raw', 2, f'station = {chr(39)}{st}{chr(39)}')} AS {name}"
    for st, name in POLLUTANT_OF_STATION.items()
) + ", MAX(ingest_seq) AS ingest_seq, CAST(NULL AS DOUBLE) AS so2\n  FROM dup_hourly GROUP BY city, timestamp)"


def _kmean(where: str | None = None) -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return f"(CAST(SUM(k){f} AS DOUBLE) / NULLIF(COUNT(k){f}, 0))"


WEATHER_HOURLY = f"""weather_hourly AS (
  SELECT city, timestamp, temp, temp + (humidity - {D(50.0)}) * {D(0.02)} AS feels_like, humidity, pressure,
         wind_speed, wind_direction,
         CASE WHEN _rain > 0 THEN _rain WHEN _rain IS NOT NULL THEN {D(0.0)} END AS precipitation,
         weather_code, CAST(NULL AS DOUBLE) AS visibility
  FROM (SELECT city, timestamp,
          {_kmean()} AS humidity,
          {_kmean("station = 'signup'")} * {D(0.45)} AS temp,
          {_kmean("station = 'purchase'")} / {D(8.0)} AS wind_speed,
          ({_kmean("station = 'view'")} - {D(60.0)}) / {D(20.0)} AS _rain,
          {D(990.0)} + {_kmean("station = 'click'")} * {D(0.4)} AS pressure,
          CAST(SUM(k) % 360 AS DOUBLE) AS wind_direction,
          MAX(k) AS weather_code
        FROM dup_hourly GROUP BY city, timestamp) w)"""

DAILY_LONG = f"""daily_long AS (
  SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS date, {emean('o_totalprice', 9)} / {D(1000.0)} AS aqi,
         COUNT(*) AS n_readings, {CITY} AS city, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS timestamp
  FROM orders GROUP BY CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP))"""

STATION_HOURLY = f"""station_hourly AS (
  SELECT station, timestamp, pm25, ingest_seq, {aqi_sql('pm25')} AS aqi FROM (
    SELECT station, timestamp, {emean('pm25_raw', 9)} AS pm25, MAX(ingest_seq) AS ingest_seq
    FROM dup_hourly GROUP BY station, timestamp) s)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def base_ctes(*extra: str, obs_digits: int = 0, obs_policy: str = "reference") -> list[str]:
    return [OBS_RAW, DUP_HOURLY, obs_hourly_cte(obs_digits, obs_policy), PARAMS_HOURLY, WEATHER_HOURLY,
            DAILY_LONG, STATION_HOURLY, *extra]


# ---------------------------------------------------------------- composite pieces
def cal_sql(ts: str = "timestamp") -> str:
    return (f"CAST(hour({ts}) AS INTEGER) AS hour, CAST(day({ts}) AS INTEGER) AS day, "
            f"CAST(month({ts}) AS INTEGER) AS month, CAST(isodow({ts}) - 1 AS INTEGER) AS dayofweek, "
            f"CAST(isodow({ts}) - 1 >= 5 AS INTEGER) AS is_weekend, "
            f"CAST(hour({ts}) IN (7, 8, 9, 17, 18, 19) AS INTEGER) AS is_rush_hour")


FEATURE_TABLE = FEATURE_TABLE_COLS


def silver_cte(name: str = "silver", digits: int = 0, policy: str = "reference") -> str:
    cols = ", ".join(FEATURE_TABLE)
    return f"""{name} AS (
  SELECT {cols} FROM (
    SELECT j.*, {rhe("COALESCE(aqi - LAG(aqi) OVER (PARTITION BY city ORDER BY timestamp), " + D(0.0) + ")", 2)}
           AS aqi_change_rate
    FROM (SELECT p.city, p.timestamp, {aqi_sql('p.pm25', digits, policy)} AS aqi, p.pm25, p.pm10, p.no2, p.o3,
                 p.co, p.so2, w.temp, w.feels_like, w.humidity, w.pressure, w.wind_speed, w.wind_direction,
                 w.visibility, w.precipitation, w.weather_code, CAST(NULL AS VARCHAR) AS weather,
                 {cal_sql('p.timestamp')}, p.ingest_seq
          FROM weather_hourly w JOIN params_hourly p ON w.city = p.city AND w.timestamp = p.timestamp) j) k
  WHERE aqi IS NOT NULL)"""


def lerp_sql(a: str, b: str, t: str) -> str:
    return f"(CASE WHEN {t} >= {D(0.5)} THEN {b} - ({b} - {a}) * ({D(1.0)} - {t}) ELSE {a} + ({b} - {a}) * {t} END)"


def quantile_cte(name: str, src: str, keys: list[str], col: str, probs: list[float], names: list[str]) -> str:
    k = ", ".join(keys)
    pos = {p: f"(CAST(n AS DOUBLE) * {D(p)} - {D(p)})" for p in probs}
    aggs = []
    for p, nm in zip(probs, names):
        f = f"CAST(FLOOR({pos[p]}) AS BIGINT)"
        aggs.append(f"MAX(x) FILTER (WHERE r = {f}) AS a_{nm}, MAX(x) FILTER (WHERE r = LEAST({f} + 1, n - 1)) AS b_{nm}")
    outs = [lerp_sql(f"a_{nm}", f"b_{nm}", f"({pos[p]} - FLOOR({pos[p]}))") + f" AS {nm}" for p, nm in zip(probs, names)]
    return f"""{name} AS (
  SELECT {k}, n, {", ".join(outs)} FROM (
    SELECT {k}, n, {", ".join(aggs)} FROM (
      SELECT {k}, {col} AS x, ROW_NUMBER() OVER (PARTITION BY {k} ORDER BY {col}) - 1 AS r,
             COUNT(*) OVER (PARTITION BY {k}) AS n
      FROM {src} WHERE {col} IS NOT NULL AND NOT isnan({col})) rr GROUP BY {k}, n) qq)"""


def iqr_filter_cte(name: str, src: str, col: str, k: int, cols: list[str], min_count: int = 20) -> str:
    q = f"{name}_q"
    sel = ", ".join(f"s.{c}" for c in cols)
    iqr = f"({q}.q75 - {q}.q25)"
    return (quantile_cte(q, src, ["city"], col, [0.25, 0.75], ["q25", "q75"]) + f""",
{name} AS (
  SELECT {sel} FROM {src} s LEFT JOIN {q} ON s.city = {q}.city
  WHERE NOT (COALESCE({q}.n, 0) > {min_count})
     OR COALESCE(s.{col} BETWEEN {q}.q25 - {k} * {iqr} AND {q}.q75 + {k} * {iqr}, FALSE))""")


def knn_cte(name: str, src: str, cols: list[str], all_cols: list[str], k: int = 5) -> str:
    n = len(cols)
    shared = " + ".join(f"(CASE WHEN r.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END)" for c in cols)
    acc = " + ".join(f"COALESCE((r.{c} - d.{c}) * (r.{c} - d.{c}), {D(0.0)})" for c in cols)
    recv = " OR ".join(f"r.{c} IS NULL" for c in cols)
    ranked = "\n    UNION ALL\n    ".join(
        f"SELECT city, rts, '{c}' AS col, d_{c} AS v, ROW_NUMBER() OVER (PARTITION BY city, rts ORDER BY dist, dts) AS rk "
        f"FROM {name}_pairs WHERE r_{c} IS NULL AND d_{c} IS NOT NULL AND shared > 0" for c in cols)
    total = " + ".join(f"COALESCE(MAX(v) FILTER (WHERE rk = {i}), {D(0.0)})" for i in range(1, k + 1))
    wide = ", ".join(f"MAX(imp) FILTER (WHERE col = '{c}') AS k_{c}" for c in cols)
    means = ", ".join(f"{emean(c)} AS m_{c}" for c in cols)
    sel = ", ".join(
        (f"CASE WHEN s.{c} IS NULL THEN COALESCE(kw.k_{c}, mm.m_{c}) ELSE s.{c} END AS {c}" if c in cols else f"s.{c}")
        for c in all_cols)
    return f"""{name}_pairs AS (
  SELECT r.city, r.timestamp AS rts, d.timestamp AS dts, {shared} AS shared,
         (CAST({n} AS DOUBLE) / ({shared})) * ({acc}) AS dist,
         {", ".join(f"r.{c} AS r_{c}, d.{c} AS d_{c}" for c in cols)}
  FROM {src} r JOIN {src} d ON r.city = d.city WHERE {recv}),
{name}_ranked AS (
    {ranked}),
{name}_imp AS (
  SELECT city, rts, col, ({total}) / COUNT(*) AS imp FROM {name}_ranked WHERE rk <= {k} GROUP BY city, rts, col),
{name}_wide AS (SELECT city, rts, {wide} FROM {name}_imp GROUP BY city, rts),
{name}_means AS (SELECT city, {means} FROM {src} GROUP BY city),
{name} AS (
  SELECT {sel} FROM {src} s LEFT JOIN {name}_wide kw ON s.city = kw.city AND s.timestamp = kw.rts
  LEFT JOIN {name}_means mm ON s.city = mm.city)"""


def ffill_sql(c: str, keys: str = "city", order: str = "timestamp") -> str:
    return (f"COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY {order} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FIRST_VALUE({c} IGNORE NULLS) OVER "
            f"(PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")


def rolling_sql(x: str, n: int, min_periods: int = 24, include_current: bool = True, keys: str = "city",
                order: str = "timestamp", scale: int = 6) -> str:
    frame = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" if include_current else \
        f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
    w = f"(PARTITION BY {keys} ORDER BY {order} {frame})"
    return (f"(CASE WHEN COUNT({x}) OVER {w} >= {min_periods} THEN "
            f"CAST(SUM(CAST({x} AS DECIMAL(18,{scale}))) OVER {w} AS DOUBLE) / COUNT({x}) OVER {w} END)")


def cyc_sql(x: str, period: int, fn: str, digits: int = 9) -> str:
    return rhe(f"{fn}({D(2 * 3.141592653589793)} * CAST({x} AS DOUBLE) / {D(float(period))})", digits)


PRE_OUT = ["city", "timestamp", "aqi", "pm25", "pm10", "no2", "o3", "co", "so2"]
MODEL_FEATURES = FEATURE_COLS


def preprocess_ctes(src: str = "silver", name: str = "gold", knn_cols=("pm25", "pm10", "no2", "o3", "co"),
                    include_current: bool = True) -> list[str]:
    cols = FEATURE_TABLE
    dedup = f"""{name}_s0 AS (
  SELECT {", ".join(cols)} FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY city, timestamp ORDER BY ingest_seq DESC) AS _rn FROM {src}) d
  WHERE _rn = 1)"""
    f1 = iqr_filter_cte(f"{name}_f1", f"{name}_s0", "aqi", 3, cols)
    f2 = iqr_filter_cte(f"{name}_f2", f"{name}_f1", "pm25", 5, cols)
    f3 = iqr_filter_cte(f"{name}_f3", f"{name}_f2", "pm10", 5, cols)
    knn = knn_cte(f"{name}_k", f"{name}_f3", list(knn_cols), cols)
    wfill = ["temp", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction"]
    fill_sel = ", ".join(ffill_sql(c) + f" AS {c}" if c in wfill else c for c in cols)
    ff = f"{name}_ff AS (SELECT {fill_sel} FROM {name}_k)"
    feat = f"""{name} AS (
  SELECT * FROM (
    SELECT {", ".join(c for c in cols if c not in ("hour", "day", "month", "dayofweek", "is_weekend", "is_rush_hour"))},
      {cal_sql('timestamp')},
      {cyc_sql('hour(timestamp)', 24, 'sin')} AS hour_sin, {cyc_sql('hour(timestamp)', 24, 'cos')} AS hour_cos,
      {cyc_sql('month(timestamp)', 12, 'sin')} AS month_sin, {cyc_sql('month(timestamp)', 12, 'cos')} AS month_cos,
      CASE WHEN month(timestamp) IN (12, 1, 2) THEN 0 WHEN month(timestamp) IN (3, 4, 5) THEN 1
           WHEN month(timestamp) IN (6, 7, 8) THEN 2 ELSE 3 END AS season,
      LAG(aqi, 72) OVER (PARTITION BY city ORDER BY timestamp) AS aqi_lag_72h,
      LAG(aqi, 96) OVER (PARTITION BY city ORDER BY timestamp) AS aqi_lag_96h,
      {rolling_sql('aqi', 72, include_current=include_current)} AS aqi_rolling_72h,
      {rolling_sql('aqi', 96, include_current=include_current)} AS aqi_rolling_96h,
      temp * humidity AS temp_humidity, wind_speed * humidity AS wind_humidity,
      CAST(COALESCE(wind_speed < 2 AND humidity > 70, FALSE) AS INTEGER) AS is_stagnant,
      CAST(COALESCE(temp > 35, FALSE) AS INTEGER) AS is_hot, CAST(COALESCE(temp < 10, FALSE) AS INTEGER) AS is_cold,
      CAST(COALESCE(wind_speed < 2, FALSE) AS INTEGER) AS is_calm_wind,
      CAST(COALESCE(wind_speed > 8, FALSE) AS INTEGER) AS is_strong_wind
    FROM {name}_ff) g
  WHERE aqi_lag_72h IS NOT NULL)"""
    return [dedup, f1, f2, f3, knn, ff, feat]
