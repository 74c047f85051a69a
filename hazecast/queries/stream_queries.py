"""Streaming queries (X1-X5): drained with availableNow, read back, compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import oracle as O
from ..catalog import register
from ..session import scratch_path
from ..sources import bindings as B
from ..sources import landed as L
from ..streaming import jobs as X
from ..catalog import REGISTRY
from . import core, tables  # noqa: F401  (registers the batch keys whose SQL is shared)

W = O.with_ctes
C = O.base_ctes


@register("stream_ingest", REGISTRY["read_air_pollution"].sql, "X1 S1")
def q_stream_ingest(spark, sf):
    landed = scratch_path(spark, "landed-air")
    L.land_air_pollution(B.params_hourly(spark, sf), landed)
    table = scratch_path(spark, "stream-ingest-table")
    out = X.stream_ingest(spark, landed, table, B.DEFAULT_CITY)
    return out.select("city", "timestamp", "aqi", "pm25", "pm10", "no2", "o3", "co", "so2")


def _events_stream(spark, sf):
    schema = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").schema
    return X.stream_files(spark, sf, schema, fmt="parquet", glob="events.parquet")


@register("stream_hourly_means", W(*C(), body=f"""
SELECT timestamp, {O.emean('pm25_raw', 9)} AS pm25, COUNT(pm25_raw) AS n_readings FROM dup_hourly GROUP BY timestamp"""),
          "X2 A1")
def q_stream_hourly(spark, sf):
    table = scratch_path(spark, "stream-hourly-table")
    return X.stream_hourly(_events_stream(spark, sf), table, scratch_path(spark, "ckpt-hourly")) \
        .select("timestamp", "pm25", "n_readings")


@register("stream_change_rate", W(*C(), body=f"""
SELECT city, timestamp, aqi,
  {O.rhe("COALESCE(aqi - LAG(aqi) OVER (PARTITION BY city ORDER BY timestamp), " + O.D(0.0) + ")", 2)} AS aqi_change_rate,
  FALSE AS late FROM obs_hourly"""), "X3 W3")
def q_stream_change(spark, sf):
    h = B.obs_hourly(spark, sf).select("city", "timestamp", "aqi")
    landed = scratch_path(spark, "landed-hourly")
    week = F.date_trunc("week", "timestamp")
    weeks = [r["w"] for r in h.select(week.alias("w")).distinct().orderBy("w").collect()]  # a row per week
    table, checkpoint = scratch_path(spark, "stream-change-table"), scratch_path(spark, "ckpt-change")
    schema = T.StructType.fromDDL("city STRING, timestamp TIMESTAMP_NTZ, aqi DOUBLE")
    for w in weeks:  # a week lands, and a run with the same checkpoint continues from the stored state
        h.filter(week == F.lit(w)).write.mode("append").json(landed)
        out = X.stream_change_rate(X.stream_files(spark, landed, schema), table, checkpoint)
    return out.select("city", "timestamp", "aqi", "aqi_change_rate", "late")


@register("stream_upsert", REGISTRY["keep_last"].sql, "X4 K1 W5")
def q_stream_upsert(spark, sf):
    from ..functions.calendar import trunc_hour
    rows = _events_stream(spark, sf).select(
        F.lit(B.DEFAULT_CITY).alias("city"), trunc_hour(F.col("ts")).alias("timestamp"),
        F.col("event_type").alias("station"), F.col("user_id").alias("sensor"),
        F.col("value").alias("pm25_raw"), F.col("event_id").alias("ingest_seq"))
    table = scratch_path(spark, "stream-upsert-table")
    X.stream_upsert(rows, table, scratch_path(spark, "ckpt-upsert-1"), ["city", "timestamp"], "ingest_seq")
    # a replay (fresh checkpoint, same input) must leave the table unchanged
    out = X.stream_upsert(rows, table, scratch_path(spark, "ckpt-upsert-2"), ["city", "timestamp"], "ingest_seq")
    return out.select("city", "timestamp", "station", "sensor", "pm25_raw", "ingest_seq")


@register("stream_alerts", W(*C(), body=f"""
SELECT city, timestamp, aqi, {O.category_sql('aqi')} AS category FROM obs_hourly WHERE aqi > 150"""), "X5 F6")
def q_stream_alerts(spark, sf):
    landed = scratch_path(spark, "landed-alerts")
    B.obs_hourly(spark, sf).select("city", "timestamp", "aqi").write.mode("overwrite").json(landed)
    schema = T.StructType.fromDDL("city STRING, timestamp TIMESTAMP_NTZ, aqi DOUBLE")
    src = X.stream_files(spark, landed, schema)
    out = X.stream_alerts(src, scratch_path(spark, "stream-alerts-table"), scratch_path(spark, "ckpt-alerts"))
    return out.select("city", "timestamp", "aqi", "category")
