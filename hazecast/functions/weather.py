"""Weather interactions, flags, defaults, condition bands and unit handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flag thresholds.
HOT_ABOVE, COLD_BELOW, CALM_BELOW, STRONG_ABOVE = 35, 10, 2, 8
STAGNANT_WIND_BELOW, STAGNANT_HUMIDITY_ABOVE = 2, 70

# Scoring defaults (missing forecast fields) and display defaults.
SCORING_DEFAULTS = {"temp": 30.0, "humidity": 50.0, "wind_speed": 3.0, "pressure": 1010.0,
                    "wind_direction": 180.0, "precipitation": 0.0, "weather_code": 0}
DISPLAY_DEFAULTS = {"temp": 25.0, "humidity": 50.0, "pressure": 1013.0, "wind_speed": 0.0,
                    "wind_direction": 0.0}

# Condition bands.  Temperature lower bounds 40/30/20/10, humidity
# upper bounds 40/70, pressure normal range 1005..1025 (inclusive).
TEMP_BANDS = [(40, "very hot"), (30, "hot"), (20, "warm"), (10, "mild")]
TEMP_LOWEST = "cold"
HUMIDITY_BANDS = [(40, "dry"), (70, "comfortable")]
HUMIDITY_TOP = "humid"
PRESSURE_NORMAL = (1005, 1025)


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def interactions(temp: Column, humidity: Column, wind: Column) -> dict[str, Column]:
    return {"temp_humidity": temp * humidity, "wind_humidity": wind * humidity}


def weather_flags(temp: Column, wind: Column) -> dict[str, Column]:
    return {
        "is_hot": _flag(temp > HOT_ABOVE),
        "is_cold": _flag(temp < COLD_BELOW),
        "is_calm_wind": _flag(wind < CALM_BELOW),
        "is_strong_wind": _flag(wind > STRONG_ABOVE),
    }


def is_stagnant(wind: Column, humidity: Column) -> Column:
    return _flag((wind < STAGNANT_WIND_BELOW) & (humidity > STAGNANT_HUMIDITY_ABOVE))


def apply_scoring_defaults(df: DataFrame) -> DataFrame:
    """Fill missing forecast fields; ``feels_like`` falls back to ``temp``."""
    cols = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in SCORING_DEFAULTS.items() if c in df.columns}
    out = df.withColumns(cols)
    if "feels_like" in df.columns:
        out = out.withColumn("feels_like", F.coalesce(F.col("feels_like"), F.col("temp")))
    return out


def apply_display_defaults(df: DataFrame) -> DataFrame:
    cols = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DISPLAY_DEFAULTS.items() if c in df.columns}
    out = df.withColumns(cols)
    if "feels_like" in df.columns:
        out = out.withColumn("feels_like", F.coalesce(F.col("feels_like"), F.col("temp")))
    return out


def temperature_band(temp: Column) -> Column:
    expr = None
    for lower, name in TEMP_BANDS:
        expr = F.when(temp >= lower, F.lit(name)) if expr is None else expr.when(temp >= lower, F.lit(name))
    return F.when(temp.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(TEMP_LOWEST)))


def humidity_band(humidity: Column) -> Column:
    expr = None
    for upper, name in HUMIDITY_BANDS:
        expr = F.when(humidity < upper, F.lit(name)) if expr is None else expr.when(humidity < upper, F.lit(name))
    return F.when(humidity.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(HUMIDITY_TOP)))


def pressure_band(pressure: Column) -> Column:
    lo, hi = PRESSURE_NORMAL
    return (F.when(pressure.isNull(), F.lit(None).cast("string"))
             .when((pressure >= lo) & (pressure <= hi), F.lit("Normal"))
             .when(pressure > hi, F.lit("High")).otherwise(F.lit("Low")))


# Unit conversions for source-tagged readings.
KMH_PER_MS = 3.6


# Weather codes by group.  The archive writes WMO present-weather codes, the live and
# forecast feeds condition ids; each row is (lowest, highest, group).
WMO_GROUPS = [(0, 0, "Clear"), (1, 3, "Clouds"), (45, 48, "Fog"), (51, 57, "Drizzle"), (61, 67, "Rain"), (71, 77, "Snow"),
              (80, 82, "Rain"), (85, 86, "Snow"), (95, 99, "Thunderstorm")]
CONDITION_GROUPS = [(200, 299, "Thunderstorm"), (300, 399, "Drizzle"), (500, 599, "Rain"), (600, 699, "Snow"), (700, 799, "Fog"),
                    (800, 800, "Clear"), (801, 804, "Clouds")]
# The WMO code that stands for a group.
GROUP_CODE = {"Clear": 0, "Clouds": 2, "Fog": 45, "Drizzle": 51, "Rain": 61, "Snow": 71, "Thunderstorm": 95}


def _group_of(code: Column, groups: list[tuple[int, int, str]]) -> Column:
    out = F.lit(None).cast("string")
    for low, high, name in groups:
        out = F.when(code.between(low, high), F.lit(name)).otherwise(out)
    return out


def weather_group(code: Column, source: Column) -> Column:
    """Group of a weather code in the vocabulary of its source; null for codes that it does not have."""
    return F.when(source == "archive", _group_of(code, WMO_GROUPS)).otherwise(_group_of(code, CONDITION_GROUPS))


def normalise_units(df: DataFrame, source: Column) -> DataFrame:
    """Bring wind to m/s, precipitation to mm per hour and weather codes to one vocabulary, tagged by source.

    ``source`` values: ``"current"`` (m/s, mm per 1 h, condition ids), ``"archive"`` (km/h,
    mm per 1 h, WMO codes), ``"forecast3h"`` (m/s, mm per 3 h, condition ids).  A ``weather_code``, if there
    is one, becomes the WMO code (condition ids: that of their group, null where they have none), and
    ``weather_group`` names its group.
    """
    wind = F.when(source == "archive", F.col("wind_speed") / F.lit(KMH_PER_MS)).otherwise(F.col("wind_speed"))
    rain = F.when(source == "forecast3h", F.col("precipitation") / F.lit(3.0)).otherwise(F.col("precipitation"))
    out = df.withColumns({"wind_speed": wind, "precipitation": rain, "unit_source": source})
    if "weather_code" not in df.columns:
        return out
    group = weather_group(F.col("weather_code"), source)
    codes = F.create_map(*[x for k, v in GROUP_CODE.items() for x in (F.lit(k), F.lit(v))])
    code = F.when(source == "archive", F.col("weather_code")).otherwise(codes[group])
    return out.withColumns({"weather_group": group, "weather_code": code})
