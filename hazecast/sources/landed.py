"""Provider-shaped payload files derived from the driver tables.

The reference reads live provider APIs; here the same payload shapes are
*landed* as JSON files by Spark jobs over the bindings, so every reader is
exercised on data that grows with the input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """TIMESTAMP_NTZ (UTC wall clock) -> epoch seconds, without the session zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def land_air_pollution(params: DataFrame, path: str) -> None:
    comp = F.struct(F.col("pm25").alias("pm2_5"), "pm10", "no2", "o3", "co", "so2")
    params.select(epoch_seconds(F.col("timestamp")).alias("dt"),
                  F.array(F.struct(comp.alias("components"))).alias("list")).write.mode("overwrite").json(path)


def land_weather_now(weather: DataFrame, path: str) -> None:
    weather.select(
        F.lit(200).alias("cod"), epoch_seconds(F.col("timestamp")).alias("dt"),
        F.struct("temp", "feels_like", "humidity", "pressure").alias("main"),
        F.struct(F.col("wind_speed").alias("speed"),
                 F.when(F.col("weather_code") % 4 != 0, F.col("wind_direction")).alias("deg")).alias("wind"),
        F.when(F.col("weather_code") % 3 != 0, F.col("humidity") * 100).alias("visibility"),
        F.array(F.struct(F.col("weather_code").alias("id"))).alias("weather"),
        F.when(F.col("precipitation") > 0, F.struct(F.col("precipitation").alias("1h"))).alias("rain"),
    ).write.mode("overwrite").json(path)


def land_weather_archive(weather: DataFrame, path: str) -> None:
    """One columnar document per (city, day): parallel arrays in time order (at most 24 entries)."""
    fields = {"time": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm"), "temperature_2m": F.col("temp"),
              "relative_humidity_2m": F.col("humidity"), "apparent_temperature": F.col("feels_like"),
              "precipitation": F.col("precipitation"), "surface_pressure": F.col("pressure"),
              "wind_speed_10m": F.col("wind_speed"), "wind_direction_10m": F.col("wind_direction"),
              "visibility": F.col("visibility"), "weather_code": F.col("weather_code")}
    day = weather.withColumn("_d", F.to_date("timestamp"))
    g = day.groupBy("city", "_d").agg(F.sort_array(F.collect_list(F.struct(
        F.col("timestamp").alias("_t"), *[c.alias(n) for n, c in fields.items()]))).alias("rows"))
    def field(name):
        return F.transform("rows", lambda r: r[name]).alias(name)
    hourly = F.struct(*[field(n) for n in fields])
    g.select("city", hourly.alias("hourly")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def land_measurements(raw: DataFrame, path: str, page_size: int = 1000) -> None:
    """Measurement pages: one document per (location, page) of at most ``page_size`` results."""
    r = raw.select(F.col("station").alias("location"), F.col("ingest_seq"),
                   F.struct(F.col("pm25_raw").alias("value"), F.struct(F.struct(
                       F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("utc"))
                       .alias("datetimeFrom")).alias("period")).alias("m"))
    g = r.groupBy("location", F.floor(F.col("ingest_seq") / page_size).alias("page")).agg(
        F.collect_list("m").alias("results"))
    g.select(F.abs(F.xxhash64("location")).alias("location_id"), "results").write.mode("overwrite").json(path)


def land_forecast_3h(weather: DataFrame, path: str) -> None:
    """3-hourly forecast documents: one per (city, day), entries at hours divisible by 3."""
    w = weather.filter(F.hour("timestamp") % 3 == 0).withColumn("_d", F.to_date("timestamp"))
    item = F.struct(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("dt_txt"),
                    F.struct("temp", "feels_like", "humidity", "pressure").alias("main"),
                    F.struct(F.col("wind_speed").alias("speed"), F.col("wind_direction").alias("deg")).alias("wind"),
                    F.when(F.col("precipitation") > 0, F.struct((F.col("precipitation") * 3).alias("3h"))).alias("rain"),
                    F.array(F.struct(F.col("weather_code").alias("id"))).alias("weather"))
    g = w.groupBy("city", "_d").agg(F.collect_list(item).alias("list"))
    g.select(F.lit("200").alias("cod"), "list").write.mode("overwrite").json(path)


def land_station_feeds(station_hourly: DataFrame, path: str) -> None:
    """Per station and hour a feed document; hours without an index carry status 'error' and aqi '-'."""
    s = station_hourly
    iaqi = F.create_map(F.lit("pm25"), F.struct(F.col("pm25").alias("v")))
    s.select(F.when(F.col("aqi").isNull(), F.lit("error")).otherwise(F.lit("ok")).alias("status"),
             F.struct(F.coalesce(F.col("aqi").cast("int").cast("string"), F.lit("-")).alias("aqi"),
                      iaqi.alias("iaqi"), F.struct(F.col("station").alias("name")).alias("city"),
                      F.struct(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("s")).alias("time"))
             .alias("data")).write.mode("overwrite").json(path)


def land_locations(raw: DataFrame, path: str) -> None:
    """Locations = stations (one document each); coordinates derived from the mean sensor id;
    sensors = distinct sensor ids of the station."""
    g = raw.groupBy("station").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.sort_array(F.collect_set("sensor")).alias("sensors"), F.avg("sensor").alias("ms"))
    loc = F.struct(F.abs(F.xxhash64("station")).alias("id"), F.col("station").alias("name"),
                   F.struct((F.lit(33.6) + F.col("ms") / 1000.0).alias("latitude"),
                            (F.lit(73.0) + F.col("ms") / 2000.0).alias("longitude")).alias("coordinates"),
                   F.transform("sensors", lambda x: F.struct(F.struct(F.concat(F.lit("sensor_"), x.cast("string"))
                                                                      .alias("name")).alias("parameter"))).alias("sensors"),
                   F.struct(F.date_format("first", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")).alias("datetimeFirst"),
                   F.struct(F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")).alias("datetimeLast"))
    g.select(F.array(loc).alias("results")).write.mode("overwrite").json(path)
