"""PM2.5 to index conversion and index categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_half_even

# US EPA PM2.5 breakpoints (concentration low, concentration high,
# index low, index high), in ascending order.
PM25_BREAKPOINTS = [
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 350.4, 301, 400),
    (350.5, 500.4, 401, 500),
]
BEYOND_SCALE = 500.0

# Six-band category names, upper bounds (inclusive) and colours.
CATEGORY_BANDS = [
    (50, "Good", "#16a34a"),
    (100, "Moderate", "#ca8a04"),
    (150, "Unhealthy for Sensitive", "#ea580c"),
    (200, "Unhealthy", "#dc2626"),
    (300, "Very Unhealthy", "#9333ea"),
]
TOP_CATEGORY = ("Hazardous", "#9f1239")

# Four-band variant used by the multi-station view.
CATEGORY4_BANDS = [
    (50, "Good"),
    (100, "Moderate"),
    (150, "Unhealthy for Sensitive Groups"),
]
TOP_CATEGORY4 = "Unhealthy / Hazardous"

GAP_POLICIES = ("reference", "truncate")


def band_slope(band) -> float:
    c_lo, c_hi, i_lo, i_hi = band
    return (i_hi - i_lo) / (c_hi - c_lo)


def pm25_to_aqi(pm25: Column, digits: int = 0, gap_policy: str = "truncate") -> Column:
    """Piecewise-linear index from a PM2.5 concentration.

    ``gap_policy="truncate"`` (default): the concentration is truncated to 0.1 first, so
    no value falls between two bands.  ``"reference"``: values between bands (12.0 < x < 12.1,
    ...) match no band and get the beyond-scale value.  Null, NaN and negative
    inputs give null.
    """
    if gap_policy not in GAP_POLICIES:
        raise ValueError(f"gap_policy must be one of {GAP_POLICIES}")
    x = pm25.cast("double")
    if gap_policy == "truncate":
        x = F.floor(x * F.lit(10.0)) / F.lit(10.0)
    expr = None
    for band in PM25_BREAKPOINTS:
        c_lo, c_hi, i_lo, _ = band
        value = round_half_even(F.lit(band_slope(band)) * (x - F.lit(c_lo)) + F.lit(float(i_lo)), digits)
        cond = (x >= F.lit(c_lo)) & (x <= F.lit(c_hi))
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    invalid = pm25.isNull() | F.isnan(pm25.cast("double")) | (pm25.cast("double") < 0)
    return F.when(invalid, F.lit(None).cast("double")).otherwise(expr.otherwise(F.lit(BEYOND_SCALE)))


def aqi_category(aqi: Column) -> Column:
    expr = None
    for upper, name, _ in CATEGORY_BANDS:
        cond = aqi <= F.lit(upper)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.when(aqi.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(TOP_CATEGORY[0])))


def aqi_color(aqi: Column) -> Column:
    expr = None
    for upper, _, colour in CATEGORY_BANDS:
        cond = aqi <= F.lit(upper)
        expr = F.when(cond, F.lit(colour)) if expr is None else expr.when(cond, F.lit(colour))
    return F.when(aqi.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(TOP_CATEGORY[1])))


def aqi_category4(aqi: Column) -> Column:
    expr = None
    for upper, name in CATEGORY4_BANDS:
        cond = aqi <= F.lit(upper)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.when(aqi.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(TOP_CATEGORY4)))
