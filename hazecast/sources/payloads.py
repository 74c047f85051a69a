"""Readers for landed provider payloads (JSON) and the feature store (Parquet/CSV/JDBC).

Every reader uses an explicit schema, so files are parsed on the executors
with no inference pass; malformed records become nulls (PERMISSIVE) and are
filtered out rather than failing the job.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.aqi import pm25_to_aqi
from ..functions.calendar import TS_FORMAT
from ..functions.rounding import round_half_even
from ..operators.filters import feed_ok, valid_measurement
from ..session import staged_table


# Provider field names -> canonical names.
ARCHIVE_NAMES = {"time": "timestamp", "temperature_2m": "temp", "relative_humidity_2m": "humidity",
                 "apparent_temperature": "feels_like", "precipitation": "precipitation",
                 "surface_pressure": "pressure", "wind_speed_10m": "wind_speed",
                 "wind_direction_10m": "wind_direction", "visibility": "visibility", "weather_code": "weather_code"}
# Defaults of the current-weather payload.
WEATHER_NOW_DEFAULTS = {"wind_direction": 0.0, "visibility": 10000.0, "precipitation": 0.0}
COMPONENT_NAMES = {"pm2_5": "pm25", "pm10": "pm10", "no2": "no2", "o3": "o3", "co": "co", "so2": "so2"}


def from_epoch_seconds(c: Column) -> Column:
    """Epoch seconds -> UTC wall clock as TIMESTAMP_NTZ (no session-zone dependence)."""
    return F.timestamp_add("SECOND", c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


_STAMP = r"^\s*(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)"


def parse_iso(c: Column) -> Column:
    """ISO-8601 text -> UTC wall clock as TIMESTAMP_NTZ; bad text -> null.

    Seconds, a fraction of any length (cut to microseconds) and an offset (``Z``, ``+05:00``,
    ``+0500``, ``+05``) may follow the minutes; without an offset the text is taken as UTC.
    Only texts with an offset other than zero go through its arithmetic.
    """
    wall = F.translate(F.regexp_extract(c, _STAMP, 1), ",", ".").try_cast("timestamp_ntz")
    offset = F.trim(F.regexp_replace(c, _STAMP, ""))
    digits = F.rpad(F.translate(offset, "+-:", ""), 4, "0")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    shifted = F.timestamp_add("MINUTE", F.when(offset.startswith("-"), minutes).otherwise(-minutes), wall)
    return (F.when(offset.isin("", "Z", "+00:00"), wall)
            .when(offset.rlike(r"^[+-]\d{2}(:?\d{2})?$"), shifted))


def _json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_air_pollution(spark: SparkSession, path: str, city: str | None = None) -> DataFrame:
    """``list[0].components``: missing pollutant -> 0.0, two decimals; index from unrounded PM2.5."""
    d = _json(spark, path, S.AIR_POLLUTION).filter(F.size("list") > 0)
    comp = F.get(F.col("list"), 0)["components"]
    cols = {out: F.coalesce(comp[src], F.lit(0.0)) for src, out in COMPONENT_NAMES.items()}
    out = d.select(from_epoch_seconds(F.col("dt")).alias("timestamp"), *[c.alias(n) for n, c in cols.items()])
    out = out.withColumn("aqi", pm25_to_aqi(F.col("pm25"), 0, "reference"))
    out = out.withColumns({n: round_half_even(F.col(n), 2) for n in COMPONENT_NAMES.values()})
    return out.withColumn("city", F.lit(city)) if city else out


def read_weather_now(spark: SparkSession, path: str, city: str | None = None) -> DataFrame:
    d = _json(spark, path, S.WEATHER_NOW).filter(F.col("cod") == 200)
    out = d.select(
        from_epoch_seconds(F.col("dt")).alias("timestamp"),
        F.col("main.temp").alias("temp"), F.col("main.feels_like").alias("feels_like"),
        F.col("main.humidity").alias("humidity"), F.col("main.pressure").alias("pressure"),
        F.col("wind.speed").alias("wind_speed"),
        F.coalesce(F.col("wind.deg"), F.lit(WEATHER_NOW_DEFAULTS["wind_direction"])).alias("wind_direction"),
        F.coalesce(F.col("visibility"), F.lit(WEATHER_NOW_DEFAULTS["visibility"])).alias("visibility"),
        F.get(F.col("weather"), 0)["id"].alias("weather_code"),
        F.coalesce(F.col("rain").getField("1h"), F.lit(WEATHER_NOW_DEFAULTS["precipitation"])).alias("precipitation"))
    return out.withColumn("city", F.lit(city)) if city else out


def read_weather_hourly(spark: SparkSession, path: str) -> DataFrame:
    """Columnar payload (parallel arrays) -> one row per hour with canonical names."""
    d = _json(spark, path, S.WEATHER_ARCHIVE)
    fields = list(ARCHIVE_NAMES)
    hourly_type = d.schema["hourly"].dataType
    # a variable missing from the payload becomes an empty array, i.e. a null column after zipping
    arrays = [F.coalesce(F.col("hourly")[f], F.array().cast(hourly_type[f].dataType)).alias(f) for f in fields]
    z = d.select("city", F.explode(F.arrays_zip(*arrays)).alias("r"))
    out = z.select("city", *[F.col("r")[f].alias(ARCHIVE_NAMES[f]) for f in fields])
    return out.withColumn("timestamp", parse_iso(F.col("timestamp")))


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Measurement pages -> (location, timestamp, pm25_raw); null or negative values and bad stamps skipped."""
    d = _json(spark, path, S.MEASUREMENTS)
    e = d.select("location_id", F.explode("results").alias("m"))
    out = e.select("location_id", parse_iso(F.col("m.period.datetimeFrom.utc")).alias("timestamp"),
                   F.col("m.value").alias("pm25_raw"))
    return out.filter(valid_measurement(F.col("pm25_raw")) & F.col("timestamp").isNotNull())


def read_weather_forecast(spark: SparkSession, path: str, city: str | None = None) -> DataFrame:
    """3-hourly forecast list -> rows; missing rain.3h -> 0, missing deg -> 0."""
    d = _json(spark, path, S.WEATHER_FORECAST_3H).filter(F.col("cod") == "200")
    e = d.select(F.explode("list").alias("i"))
    out = e.select(
        F.try_to_timestamp(F.col("i.dt_txt"), F.lit(TS_FORMAT)).cast("timestamp_ntz").alias("timestamp"),
        F.col("i.main.temp").alias("temp"), F.col("i.main.feels_like").alias("feels_like"),
        F.col("i.main.humidity").alias("humidity"), F.col("i.main.pressure").alias("pressure"),
        F.col("i.wind.speed").alias("wind_speed"), F.coalesce(F.col("i.wind.deg"), F.lit(0.0)).alias("wind_direction"),
        F.coalesce(F.col("i.rain").getField("3h"), F.lit(0.0)).alias("precipitation"),
        F.get(F.col("i.weather"), 0)["id"].alias("weather_code"))
    return out.withColumn("city", F.lit(city)) if city else out


def read_station_feed(spark: SparkSession, path: str) -> DataFrame:
    """Station feeds: status ok and numeric index > 0; pollutant values optional (map lookups)."""
    d = _json(spark, path, S.STATION_FEED)
    ok = d.filter(feed_ok(F.col("status"), F.col("data.aqi")))
    iaqi = F.col("data.iaqi")
    pol = {p: F.try_element_at(iaqi, F.lit(p))["v"] for p in ("pm25", "pm10", "no2", "o3", "co", "so2")}
    return ok.select(F.col("data.city.name").alias("station"), F.col("data.aqi").try_cast("double").alias("aqi"),
                     F.try_to_timestamp(F.col("data.time.s"), F.lit(TS_FORMAT)).cast("timestamp_ntz").alias("timestamp"),
                     *[c.alias(n) for n, c in pol.items()])


EARTH_RADIUS_M = 6371000.0


def haversine_m(lat1: Column, lon1: Column, lat2: float, lon2: float) -> Column:
    p1, p2 = F.radians(lat1), F.radians(F.lit(lat2))
    dphi = p2 - p1
    dl = F.radians(F.lit(lon2)) - F.radians(lon1)
    a = F.sin(dphi / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) ** 2
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def read_locations(spark: SparkSession, path: str, lat: float, lon: float, radius_m: float = 25000.0,
                   limit: int = 10) -> DataFrame:
    """Locations within ``radius_m`` of (lat, lon), nearest first, at most ``limit``."""
    d = _json(spark, path, S.LOCATIONS)
    e = d.select(F.explode("results").alias("l"))
    out = e.select(F.col("l.id").alias("id"), F.col("l.name").alias("name"),
                   F.transform(F.col("l.sensors"), lambda s: s["parameter"]["name"]).alias("sensors"),
                   F.col("l.datetimeFirst.utc").alias("first_utc"), F.col("l.datetimeLast.utc").alias("last_utc"),
                   haversine_m(F.col("l.coordinates.latitude"), F.col("l.coordinates.longitude"), lat, lon)
                   .alias("distance_m"))
    return out.filter(F.col("distance_m") <= radius_m).orderBy("distance_m", "id").limit(limit)


def read_store(spark: SparkSession, path: str | None = None, jdbc_url: str | None = None,
               table: str = "aqi_features", num_partitions: int = 64, bounds: tuple[str, str] | None = None,
               properties: dict | None = None) -> DataFrame:
    """Feature store: Parquet table (partition-pruned scans) or JDBC with a partitioned range read."""
    if path is not None:
        return spark.read.parquet(path)
    if bounds is None:
        raise ValueError("a JDBC read needs bounds (lowest and highest timestamp) to be split over tasks")
    reader = spark.read.format("jdbc").option("url", jdbc_url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return (reader.option("partitionColumn", "timestamp").option("lowerBound", bounds[0])
            .option("upperBound", bounds[1]).option("numPartitions", num_partitions).load())


def read_store_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV copy of the store with typed columns and parsed time."""
    raw = spark.read.option("header", True).schema(
        ", ".join(f"`{f.name}` STRING" for f in S.struct(S.FEATURE_TABLE).fields)).csv(path)
    from ..functions.sanitise import coerce_types
    typed = coerce_types(raw).withColumn("timestamp", parse_iso(F.col("timestamp")))
    return typed.withColumn("ingest_seq", F.col("ingest_seq").try_cast("bigint"))


def read_with_fallback(primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame], read_through: bool = False) -> DataFrame:
    """Use ``primary`` unless its source is missing or cannot be reached when it is resolved.

    With ``read_through`` the primary is read to its end and staged in the shared folder first, so
    that a store that fails while it is read (a broken file, a lost connection) selects the fallback as
    well, and nothing of a half-read store is used.  Only Spark's errors select the fallback; other
    errors, such as those of a program, are raised.
    """
    try:
        df = primary()
        df.schema  # resolve now, so a missing source fails here
        return staged_table(df, "read-through") if read_through else df
    except (AnalysisException, PySparkException, Py4JJavaError) as e:
        warnings.warn(f"store not readable, falling back: {str(e).splitlines()[0]}", stacklevel=2)
        return fallback()


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Model metadata JSON, in one line or indented.  A missing registry gives an empty frame; one
    that cannot be read gives an empty frame with a warning."""
    from ..models.train import REGISTRY_SCHEMA
    try:
        files = spark.read.text(path, wholetext=True)  # one small file per registry version
    except AnalysisException:
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    d = files.select(F.from_json("value", REGISTRY_SCHEMA).alias("m")).select("m.*")
    d = d.filter(F.col("best_model").isNotNull())
    if d.limit(1).count() == 0 and files.filter(F.trim("value") != "").limit(1).count():
        warnings.warn(f"registry {path} is not readable", stacklevel=2)
    return d


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(S.IMPORTANCE).csv(path)
