"""NaN/Inf sanitising, typed coercion and metric rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rounding import round_half_even

# The typed columns of the feature table.
INTEGER_COLS = ["hour", "day", "month", "dayofweek", "is_weekend", "is_rush_hour", "weather_code"]
FLOAT_COLS = ["aqi", "pm25", "pm10", "no2", "o3", "co", "so2", "temp", "feels_like", "humidity",
              "pressure", "wind_speed", "wind_direction", "visibility", "precipitation",
              "aqi_change_rate"]
TEXT_COLS = ["timestamp", "city", "weather"]


def clean_double(c: Column) -> Column:
    """NaN and +/-Inf become null."""
    d = c.cast("double")
    bad = F.isnan(d) | (d == F.lit(float("inf"))) | (d == F.lit(float("-inf")))
    return F.when(bad, F.lit(None).cast("double")).otherwise(d)


def sanitise(df: DataFrame, float_digits: int | None = None) -> DataFrame:
    """Map NaN/Inf to null in every floating column; optionally round floats."""
    cols = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = clean_double(F.col(f.name))
            cols[f.name] = round_half_even(c, float_digits) if float_digits is not None else c
    return df.withColumns(cols) if cols else df


def coerce_types(df: DataFrame, ints=INTEGER_COLS, floats=FLOAT_COLS, int_null_to_zero: bool = False) -> DataFrame:
    """Non-numeric text becomes null; integer columns are rounded half-even first."""
    cols = {}
    for c in ints:
        if c in df.columns:
            v = F.bround(clean_double(F.col(c).try_cast("double")), 0).try_cast("int")
            cols[c] = F.coalesce(v, F.lit(0)) if int_null_to_zero else v
    for c in floats:
        if c in df.columns:
            cols[c] = clean_double(F.col(c).try_cast("double"))
    return df.withColumns(cols) if cols else df


def bad_value_count(df: DataFrame) -> DataFrame:
    """Number of NaN/Inf cells left over all floating columns (must be 0)."""
    terms = [F.sum((F.isnan(F.col(f.name)) | (F.abs(F.col(f.name)) == F.lit(float("inf")))).cast("long"))
             for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    total = F.lit(0).cast("long")
    for t in terms:
        total = total + F.coalesce(t, F.lit(0).cast("long"))
    return df.agg(total.alias("bad_values"))


def round_metrics(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: round_half_even(F.col(c), digits) for c in cols})
