"""Bindings of the driver tables to the engine's readings model.

``events`` plays the role of raw sensor readings: ``ts`` is the reading time,
``event_type`` the station, ``user_id`` the sensor, ``value`` the raw PM2.5,
``props.k`` a 0..99 reading used for weather, ``event_id`` the ingest order.
``orders`` by day gives a long daily series that spans months and years.
Means are exact (decimal sums, one division) so results do not depend on the
partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aqi import pm25_to_aqi
from ..functions.calendar import trunc_hour
from ..functions.rounding import exact_mean
from ..session import table

DEFAULT_CITY = "central"

# Which station stands for which pollutant.
POLLUTANT_OF_STATION = {"click": "pm25", "error": "pm10", "purchase": "no2", "signup": "o3", "view": "co"}
# Station -> city: every station of the driver data is in the one city of the feature store.
CITY_OF_STATION = {station: DEFAULT_CITY for station in POLLUTANT_OF_STATION}


def city_of(station):
    """City of a reading, looked up from its station (a data column, so joins on city stay equi-joins)."""
    m = F.create_map(*[x for k, v in CITY_OF_STATION.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[station], F.lit(DEFAULT_CITY))
POLLUTANTS = ["pm25", "pm10", "no2", "o3", "co", "so2"]
WEATHER_COLS = ["temp", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction"]


def obs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        city_of(F.col("event_type")).alias("city"),
        F.col("ts"),
        F.col("event_type").alias("station"),
        F.col("user_id").alias("sensor"),
        F.col("value").alias("pm25_raw"),
        F.from_json("props", "k INT")["k"].alias("k"),
        F.col("event_id").alias("ingest_seq"),
    )


def dup_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings stamped to the hour: many rows per (city, timestamp)."""
    return obs_raw(spark, sf_dir).withColumn("timestamp", trunc_hour(F.col("ts"))).drop("ts")


def obs_hourly(spark: SparkSession, sf_dir: str, digits: int = 0, gap_policy: str = "reference") -> DataFrame:
    raw = dup_hourly(spark, sf_dir)
    hourly = raw.groupBy("city", "timestamp").agg(
        exact_mean(F.col("pm25_raw")).alias("pm25"),
        F.count("pm25_raw").alias("n_readings"),
    )
    return hourly.withColumn("aqi", pm25_to_aqi(F.col("pm25"), digits, gap_policy))


def params_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pollutant pivot per hour; a pollutant with no reading that hour is null."""
    raw = dup_hourly(spark, sf_dir)
    aggs = []
    for station, name in POLLUTANT_OF_STATION.items():
        v = F.when(F.col("station") == station, F.col("pm25_raw"))
        aggs.append(exact_mean(v).alias(name))
    aggs.append(F.max("ingest_seq").alias("ingest_seq"))
    out = raw.groupBy("city", "timestamp").agg(*aggs)
    return out.withColumn("so2", F.lit(None).cast("double"))


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dup_hourly(spark, sf_dir)
    k = F.col("k")

    def kmean(station=None):
        v = k if station is None else F.when(F.col("station") == station, k)
        return F.sum(v).cast("double") / F.nullif(F.count(v), F.lit(0))

    g = raw.groupBy("city", "timestamp").agg(
        kmean().alias("humidity"),
        (kmean("signup") * F.lit(0.45)).alias("temp"),
        (kmean("purchase") / F.lit(8.0)).alias("wind_speed"),
        ((kmean("view") - F.lit(60.0)) / F.lit(20.0)).alias("_rain"),
        (F.lit(990.0) + kmean("click") * F.lit(0.4)).alias("pressure"),
        (F.sum(k) % 360).cast("double").alias("wind_direction"),
        F.max(k).alias("weather_code"),
    )
    return g.select(
        "city", "timestamp", "temp",
        (F.col("temp") + (F.col("humidity") - F.lit(50.0)) * F.lit(0.02)).alias("feels_like"),
        "humidity", "pressure", "wind_speed", "wind_direction",
        F.when(F.col("_rain") > 0, F.col("_rain")).when(F.col("_rain").isNotNull(), F.lit(0.0)).alias("precipitation"),
        "weather_code",
        F.lit(None).cast("double").alias("visibility"),
    )


def daily_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily index series spanning years: mean order price per day / 1000."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.to_date("o_orderdate").cast("timestamp_ntz").alias("date"))
             .agg((exact_mean(F.col("o_totalprice")) / F.lit(1000.0)).alias("aqi"),
                  F.count(F.lit(1)).alias("n_readings"))
             .withColumn("city", F.lit(DEFAULT_CITY))
             .withColumn("timestamp", F.col("date")))


def station_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hourly series per station: many keys for keyed windows."""
    raw = dup_hourly(spark, sf_dir)
    g = raw.groupBy("station", "timestamp").agg(exact_mean(F.col("pm25_raw")).alias("pm25"),
                                                 F.max("ingest_seq").alias("ingest_seq"))
    return g.withColumn("aqi", pm25_to_aqi(F.col("pm25"), 0, "reference"))
