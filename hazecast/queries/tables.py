"""Source and sink queries: landed payloads read back (S1-S12) and table maintenance (K1-K7).

Each query lands provider-shaped files or a table, derived from the driver
tables, in the shared checkpoint folder, then runs the reader or maintenance
operator on them; the oracle computes the same result from the bindings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ..catalog import register
from ..functions.calendar import round_hour
from ..functions.aqi import pm25_to_aqi
from ..functions.sanitise import sanitise
from ..functions.weather import normalise_units
from ..operators.aggregates import mean_per_timestamp, station_average
from ..plans.history import backfill_measured
from ..session import scratch_path
from ..sinks import files as K
from ..sources import bindings as B
from ..sources import landed as L
from ..sources import payloads as S
from .composite import silver

W = O.with_ctes
C = O.base_ctes
D = O.D
SILVER = C(O.silver_cte())
FT = O.FEATURE_TABLE


@register("read_air_pollution", W(*C(), body=f"""
SELECT '{B.DEFAULT_CITY}' AS city, timestamp, {O.aqi_sql('COALESCE(pm25, ' + D(0.0) + ')')} AS aqi,
  {", ".join(O.rhe(f"COALESCE({c}, {D(0.0)})", 2) + f" AS {c}" for c in ["pm25", "pm10", "no2", "o3", "co", "so2"])}
FROM params_hourly"""), "S1 P1 P18")
def q_air(spark, sf):
    path = scratch_path(spark, "air-pollution")
    L.land_air_pollution(B.params_hourly(spark, sf), path)
    return S.read_air_pollution(spark, path, B.DEFAULT_CITY).select(
        "city", "timestamp", "aqi", "pm25", "pm10", "no2", "o3", "co", "so2")


@register("read_weather_now", W(*C(), body=f"""
SELECT '{B.DEFAULT_CITY}' AS city, timestamp, temp, feels_like, humidity, pressure, wind_speed,
  CASE WHEN weather_code % 4 <> 0 AND wind_direction IS NOT NULL THEN wind_direction ELSE {D(0.0)} END AS wind_direction,
  CASE WHEN weather_code % 3 <> 0 AND humidity IS NOT NULL THEN humidity * 100 ELSE {D(10000.0)} END AS visibility,
  weather_code, CASE WHEN precipitation > 0 THEN precipitation ELSE {D(0.0)} END AS precipitation
FROM weather_hourly"""), "S2 P26")
def q_weather_now(spark, sf):
    path = scratch_path(spark, "weather-now")
    L.land_weather_now(B.weather_hourly(spark, sf), path)
    return S.read_weather_now(spark, path, B.DEFAULT_CITY).select(
        "city", "timestamp", "temp", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction",
        "visibility", "weather_code", "precipitation")


@register("read_weather_archive", W(*C(), body="""
SELECT city, timestamp, temp, humidity, feels_like, precipitation, pressure, wind_speed, wind_direction,
       visibility, weather_code FROM weather_hourly"""), "S3 P4")
def q_archive(spark, sf):
    path = scratch_path(spark, "weather-archive")
    L.land_weather_archive(B.weather_hourly(spark, sf), path)
    return S.read_weather_hourly(spark, path).select(
        "city", "timestamp", "temp", "humidity", "feels_like", "precipitation", "pressure", "wind_speed",
        "wind_direction", "visibility", "weather_code")


_RH = """CASE WHEN epoch_us(ts) - epoch_us(date_trunc('hour', ts)) > 1800000000 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR
       WHEN epoch_us(ts) - epoch_us(date_trunc('hour', ts)) < 1800000000 THEN date_trunc('hour', ts)
       WHEN hour(ts) % 2 = 1 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR ELSE date_trunc('hour', ts) END"""


@register("read_measurements", W(*C(), body=f"""
SELECT timestamp, pm25, n_readings, {O.aqi_sql('pm25', 1)} AS aqi FROM (
  SELECT {_RH} AS timestamp, {O.emean('pm25_raw', 9)} AS pm25, COUNT(pm25_raw) AS n_readings
  FROM obs_raw WHERE pm25_raw IS NOT NULL AND pm25_raw >= 0 GROUP BY 1) m"""), "S4 F2 U2 P16 P17 A1 M1")
def q_measurements(spark, sf):
    path = scratch_path(spark, "measurements")
    L.land_measurements(B.obs_raw(spark, sf), path)
    m = S.read_measurements(spark, path).withColumn("timestamp", round_hour(F.col("timestamp")))
    h = mean_per_timestamp(m, ["timestamp"], "pm25_raw", "pm25")
    return h.withColumn("aqi", pm25_to_aqi(F.col("pm25"), 1, "reference")).select("timestamp", "pm25", "n_readings", "aqi")


@register("read_weather_forecast", W(*C(), body=f"""
SELECT '{B.DEFAULT_CITY}' AS city, timestamp, temp, feels_like, humidity, pressure, wind_speed,
  COALESCE(wind_direction, {D(0.0)}) AS wind_direction,
  CASE WHEN precipitation > 0 THEN precipitation * 3 ELSE {D(0.0)} END AS precipitation,
  CASE WHEN precipitation > 0 THEN (precipitation * 3) / {D(3.0)} ELSE {D(0.0)} / {D(3.0)} END AS precipitation_1h,
  weather_code
FROM weather_hourly WHERE hour(timestamp) % 3 = 0"""), "S5 P19")
def q_forecast(spark, sf):
    path = scratch_path(spark, "forecast-3h")
    L.land_forecast_3h(B.weather_hourly(spark, sf), path)
    f = S.read_weather_forecast(spark, path, B.DEFAULT_CITY)
    n = normalise_units(f.select("timestamp", F.col("precipitation"), F.col("wind_speed")), F.lit("forecast3h"))
    return f.join(n.select("timestamp", F.col("precipitation").alias("precipitation_1h")), "timestamp").select(
        "city", "timestamp", "temp", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction",
        "precipitation", "precipitation_1h", "weather_code")


@register("read_station_feed", W(*C(), body=f"""
SELECT station, timestamp, CAST(CAST(aqi AS INTEGER) AS DOUBLE) AS aqi, pm25 FROM station_hourly
WHERE aqi IS NOT NULL AND aqi > 0"""), "S6 F5")
def q_feed(spark, sf):
    path = scratch_path(spark, "station-feed")
    L.land_station_feeds(B.station_hourly(spark, sf), path)
    return S.read_station_feed(spark, path).select("station", "timestamp", "aqi", "pm25")


@register("station_feed_average", W(*C(), body=f"""
SELECT round_even({O.emean('aqi')}, 0) AS avg_aqi, COUNT(aqi) AS stations_used FROM (
  SELECT station, arg_max(CAST(CAST(aqi AS INTEGER) AS DOUBLE), timestamp) AS aqi FROM station_hourly
  WHERE aqi IS NOT NULL AND aqi > 0 GROUP BY station) s"""), "A7 S6 F5 T2")
def q_feed_avg(spark, sf):
    path = scratch_path(spark, "station-feed-avg")
    L.land_station_feeds(B.station_hourly(spark, sf), path)
    feeds = S.read_station_feed(spark, path)
    latest = feeds.groupBy("station").agg(F.max_by("aqi", "timestamp").alias("aqi")).withColumn("_all", F.lit(1))
    return station_average(latest, ["_all"]).drop("_all")


def _hav_sql(lat: str, lon: str, lat0: float, lon0: float) -> str:
    p1, p2 = f"radians({lat})", f"radians({D(lat0)})"
    return (f"({D(2 * S.EARTH_RADIUS_M)} * asin(sqrt(pow(sin(({p2} - {p1}) / 2), 2) + cos({p1}) * cos({p2}) * "
            f"pow(sin((radians({D(lon0)}) - radians({lon})) / 2), 2))))")


_LAT0, _LON0 = 33.6844, 73.0479


@register("read_locations", W(*C(), body=f"""
SELECT name, sensors, n_sensors, first_utc, last_utc, {O.rhe('distance_m', 3)} AS distance_m FROM (
  SELECT station AS name, string_agg('sensor_' || CAST(sensor AS VARCHAR), ',' ORDER BY sensor) AS sensors,
         COUNT(*) AS n_sensors, strftime(MIN(first), '%Y-%m-%dT%H:%M:%SZ') AS first_utc,
         strftime(MAX(last), '%Y-%m-%dT%H:%M:%SZ') AS last_utc,
         {_hav_sql(f"({D(33.6)} + AVG(ms) / {D(1000.0)})", f"({D(73.0)} + AVG(ms) / {D(2000.0)})", _LAT0, _LON0)} AS distance_m
  FROM (SELECT station, sensor, MIN(ts) AS first, MAX(ts) AS last,
               (SELECT AVG(sensor) FROM obs_raw o2 WHERE o2.station = o.station) AS ms
        FROM obs_raw o GROUP BY station, sensor) s GROUP BY station) l
WHERE distance_m <= 25000 ORDER BY distance_m LIMIT 10"""), "S7")
def q_locations(spark, sf):
    from ..functions.rounding import round_half_even
    path = scratch_path(spark, "locations")
    L.land_locations(B.obs_raw(spark, sf), path)
    loc = S.read_locations(spark, path, _LAT0, _LON0, 25000.0, 10)
    return loc.select("name", F.array_join("sensors", ",").alias("sensors"), F.size("sensors").cast("long").alias("n_sensors"),
                      "first_utc", "last_utc", round_half_even(F.col("distance_m"), 3).alias("distance_m"))


@register("store_roundtrip", W(*SILVER, body=f"SELECT {', '.join(FT)} FROM silver"), "S8 K1")
def q_store(spark, sf):
    path = scratch_path(spark, "store")
    K.write_table(silver(spark, sf), path, ["city", "month"])
    return S.read_store(spark, path).select(*FT)


@register("csv_fallback", W(*SILVER, body=f"SELECT {', '.join(FT)} FROM silver"), "S9 K2")
def q_csv(spark, sf):
    csv = scratch_path(spark, "store-csv")
    silver(spark, sf).write.mode("overwrite").option("header", True).csv(csv)
    missing = scratch_path(spark, "missing-store")
    df = S.read_with_fallback(lambda: S.read_store(spark, missing), lambda: S.read_store_csv(spark, csv))
    return df.select(*FT)


_UPSERT_SQL = f"""batch AS (
  SELECT * REPLACE (aqi + 1 AS aqi, ingest_seq + 1000000000 AS ingest_seq) FROM silver WHERE day > 20
  UNION ALL SELECT * REPLACE (aqi + 2 AS aqi, ingest_seq + 2000000000 AS ingest_seq) FROM silver WHERE day > 20),
upserted AS (
  SELECT {', '.join(FT)} FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY city, timestamp ORDER BY src DESC, ingest_seq DESC) AS rn FROM (
      SELECT *, 0 AS src FROM silver UNION ALL SELECT *, 1 AS src FROM batch) u) r WHERE rn = 1)"""


def _upsert_batch(s):
    late = s.filter(F.col("day") > 20)
    return late.withColumns({"aqi": F.col("aqi") + 1, "ingest_seq": F.col("ingest_seq") + 1000000000}).unionByName(
        late.withColumns({"aqi": F.col("aqi") + 2, "ingest_seq": F.col("ingest_seq") + 2000000000}))


@register("upsert_store", W(*SILVER, _UPSERT_SQL, body=f"SELECT {', '.join(FT)} FROM upserted"), "K1 W5 U1")
def q_upsert(spark, sf):
    s = silver(spark, sf)
    target = scratch_path(spark, "upsert-target")
    K.write_table(s, target, ["city", "day"])
    out = K.upsert(spark, target, _upsert_batch(s), ["city", "timestamp"], "ingest_seq", ["city", "day"])
    return out.select(*FT)


@register("merge_csv_backup", W(*SILVER, f"""merged AS (
  SELECT {', '.join(FT)} FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY city, timestamp ORDER BY src DESC) AS rn FROM (
      SELECT *, 0 AS src FROM silver WHERE day <= 20
      UNION ALL SELECT * REPLACE (aqi + 1 AS aqi), 1 AS src FROM silver WHERE day >= 15) u) r WHERE rn = 1)""",
                                   body=f"SELECT {', '.join(FT)} FROM merged"), "K2")
def q_merge_csv(spark, sf):
    s = silver(spark, sf)
    path = scratch_path(spark, "csv-backup")
    s.filter(F.col("day") <= 20).write.mode("overwrite").option("header", True).csv(path)
    new = s.filter(F.col("day") >= 15).withColumn("aqi", F.col("aqi") + 1)
    return K.merge_csv_backup(spark, path, new).select(*FT)


@register("delete_rows", W(*SILVER, body=f"""
SELECT {', '.join(FT)} FROM silver WHERE NOT COALESCE(timestamp < TIMESTAMP '2024-01-10 00:00:00', FALSE)"""), "K4")
def q_delete(spark, sf):
    path = scratch_path(spark, "delete-target")
    K.write_table(silver(spark, sf), path, ["city", "day"])
    cutoff = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return K.delete_where(spark, path, F.col("timestamp") < cutoff, ["city", "day"]).select(*FT)


@register("reload_table", W(*SILVER, body=f"SELECT {', '.join(FT)} FROM silver"), "K5 P15 P14 A13")
def q_reload(spark, sf):
    csv = scratch_path(spark, "reload-csv")
    silver(spark, sf).write.mode("overwrite").option("header", True).csv(csv)
    target = scratch_path(spark, "reload-target")
    return K.reload_table(spark, csv, target).select(*FT)


@register("batched_write", W(*SILVER, body="""
SELECT COUNT(*) AS rows, CAST(CEIL(COUNT(*) / 100.0) AS BIGINT) AS batches, 100 AS batch_size FROM silver"""), "K3")
def q_batched(spark, sf):
    return K.batched_write(silver(spark, sf), scratch_path(spark, "batched"), 100)


@register("write_ledger", W(*SILVER, body="""
SELECT i::BIGINT AS chunk, LEAST(100, n - 100 * i)::BIGINT AS rows, 'committed' AS status, CASE WHEN i = 1 THEN 2 ELSE 1 END::BIGINT AS attempt,
       n::BIGINT AS stored
FROM (SELECT COUNT(*) AS n FROM silver) c, UNNEST(GENERATE_SERIES(0, CAST(CEIL(n / 100.0) AS BIGINT) - 1)) t(i)"""), "K3")
def q_ledger(spark, sf):
    """Chunks of 100 rows, the second of which its sink refuses; a second call writes that one alone."""
    rows, path = silver(spark, sf), scratch_path(spark, "ledger")

    def refuses(df, folder):
        if folder.endswith("chunk=000001"):
            raise ConnectionError("the sink does not answer")
        df.write.parquet(folder)
    K.chunked_write(rows, path, "load", chunk_rows=100, write=refuses)
    ledger = K.chunked_write(rows, path, "load", chunk_rows=100)
    stored = spark.read.parquet(path).count()
    return ledger.select("chunk", "rows", "status", "attempt", F.lit(stored).cast("long").alias("stored"))


_DBL = ["aqi", "pm25", "pm10", "no2", "o3", "co", "so2", "temp", "feels_like", "humidity", "pressure", "wind_speed",
        "wind_direction", "visibility", "precipitation", "aqi_change_rate"]


@register("sanitise_upload", W(*SILVER, body="SELECT city, timestamp, " + ", ".join(
    f"{O.rhe(f'CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END', 4)} AS {c}" for c in _DBL)
    + " FROM silver"), "P14 P29")
def q_sanitise(spark, sf):
    return sanitise(silver(spark, sf).select("city", "timestamp", *_DBL), float_digits=4)


def _metrics_rounded_sql():
    from .model_queries import _metrics_sql
    return _metrics_sql()


@register("registry_roundtrip", W(*SILVER, *O.preprocess_ctes(), """split AS (
  SELECT g.*, ROW_NUMBER() OVER (PARTITION BY city ORDER BY timestamp) AS rn,
         FLOOR(CAST(COUNT(*) OVER (PARTITION BY city) AS DOUBLE) * CAST('0.8' AS DOUBLE)) AS cut FROM gold g)""",
    _metrics_rounded_sql(), body=f"""
SELECT (SELECT arg_min(model, rmse) FROM metrics) AS best_model, model, {O.rhe('rmse', 4)} AS rmse,
       {O.rhe('mae', 4)} AS mae, {O.rhe('r2', 4)} AS r2, CAST(COUNT(*) OVER () AS INTEGER) AS n_models
FROM metrics"""), "K6 S10 P29 T6")
def q_registry(spark, sf):
    from ..models.train import evaluate_models, write_metadata
    from .model_queries import _baseline_predictions
    res = evaluate_models(_baseline_predictions(spark, sf))
    path = scratch_path(spark, "registry-meta")
    write_metadata(path, res, ["aqi_lag_72h", "aqi_lag_96h"], 0)
    meta = S.read_registry(spark, path)
    return _with_count(meta)


def _with_count(meta):
    """Registry rows: one per model, with the best model's name and the number of models."""
    return meta.select("best_model", F.size("all_results").alias("n_models"),
                       F.explode("all_results").alias("r")).select(
        "best_model", "r.model", "r.rmse", "r.mae", "r.r2", "n_models")


@register("backfill_measured", W(*SILVER, f"""hourly AS (
  SELECT city, {_RH} AS timestamp, {O.emean('pm25_raw', 9)} AS pm FROM obs_raw WHERE pm25_raw IS NOT NULL AND pm25_raw >= 0 GROUP BY 1, 2)""",
    f"""filled AS (
  SELECT *, {O.rhe("COALESCE(aqi - LAG(aqi) OVER (PARTITION BY city ORDER BY timestamp), " + D(0.0) + ")", 2)} AS aqi_change_rate FROM (
    SELECT w.city, w.timestamp, {O.aqi_sql('h.pm', 1)} AS aqi, {O.rhe('h.pm', 2)} AS pm25, w.temp, w.humidity, {O.cal_sql('w.timestamp')}
    FROM hourly h JOIN weather_hourly w ON h.city = w.city AND h.timestamp = w.timestamp) x WHERE aqi IS NOT NULL)""", body="""
SELECT city, timestamp, aqi, pm25, temp, humidity, hour, is_weekend, aqi_change_rate, NULL::DOUBLE AS pm10 FROM filled WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00'
UNION ALL SELECT f.city, f.timestamp, f.aqi, f.pm25, f.temp, f.humidity, f.hour, f.is_weekend, f.aqi_change_rate, s.pm10
FROM filled f LEFT JOIN silver s ON f.city = s.city AND f.timestamp = s.timestamp WHERE f.timestamp < TIMESTAMP '2024-01-10 00:00:00'
UNION ALL SELECT s.city, s.timestamp, s.aqi, s.pm25, s.temp, s.humidity, s.hour, s.is_weekend, s.aqi_change_rate, s.pm10
FROM silver s WHERE s.timestamp < TIMESTAMP '2024-01-10 00:00:00'
  AND NOT EXISTS (SELECT 1 FROM filled f WHERE f.city = s.city AND f.timestamp = s.timestamp)"""), "S4 U2 P17 A1 M1 K4 K1")
def q_backfill(spark, sf):
    """Landed measurements of all locations -> measured rows; the stored range is deleted, and the
    rows are upserted into the store."""
    path = scratch_path(spark, "backfill-measurements")
    L.land_measurements(B.obs_raw(spark, sf), path)
    m = S.read_measurements(spark, path).withColumn("city", B.city_of(F.col("location_id").cast("string")))
    rows = backfill_measured(m, B.weather_hourly(spark, sf), gap_policy="reference")
    rows = rows.select("city", "timestamp", "aqi", "pm25", "temp", "humidity", "hour", "is_weekend", "aqi_change_rate", "month", "day")
    target = scratch_path(spark, "backfill-target")
    K.write_table(silver(spark, sf), target, ["city", "month"])
    K.delete_where(spark, target, F.col("timestamp") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), ["city", "month"])
    out = K.upsert(spark, target, rows, ["city", "timestamp"], None, ["city", "month"])
    return out.select("city", "timestamp", "aqi", "pm25", "temp", "humidity", "hour", "is_weekend", "aqi_change_rate", "pm10")
