"""Weather-driven index estimators and pollutant scaling (deterministic core).

The reference adds unseeded Gaussian noise; here noise is optional and seeded
(``noise_seed``), so the deterministic core can be checked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_half_even

# Seasonal factor by month (1..12).
SEASONAL_FACTOR = {1: 1.6, 2: 1.4, 3: 1.1, 4: 0.95, 5: 1.0, 6: 0.9,
                   7: 0.8, 8: 0.82, 9: 0.9, 10: 1.1, 11: 1.4, 12: 1.6}
# Hour-of-day factor (0..23).
HOURLY_FACTOR = {0: 1.1, 1: 1.05, 2: 1.0, 3: 0.95, 4: 0.95, 5: 1.0,
                 6: 1.1, 7: 1.25, 8: 1.3, 9: 1.2, 10: 1.1, 11: 1.05,
                 12: 1.1, 13: 1.05, 14: 1.0, 15: 1.0, 16: 1.1, 17: 1.25,
                 18: 1.3, 19: 1.2, 20: 1.15, 21: 1.1, 22: 1.1, 23: 1.1}
# Monthly index baselines and monthly PM2.5 baselines (1..12).
MONTHLY_AQI_BASELINE = {1: 230, 2: 190, 3: 130, 4: 110, 5: 140, 6: 120,
                        7: 75, 8: 70, 9: 90, 10: 140, 11: 200, 12: 250}
MONTHLY_PM25_BASELINE = {1: 115, 2: 85, 3: 48, 4: 38, 5: 55, 6: 43,
                         7: 18, 8: 16, 9: 23, 10: 55, 11: 90, 12: 130}
# Weather defaults and factor constants.
EST_DEFAULTS = {"humidity": 50.0, "wind_speed": 3.0, "temp": 25.0, "precipitation": 0.0}
FLOOR_AQI = 10.0
PM10_PER_PM25 = 1.4
NOISE_SHARE_CURRENT, NOISE_SHARE_MONTHLY = 0.03, 0.05


def lookup(mapping: dict, key: Column, default: float | None = None) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(float(v)))])
    val = m[key]
    return F.coalesce(val, F.lit(default)) if default is not None else val


def _weather_product(hour: Column, humidity: Column, wind: Column, temp: Column, rain: Column,
                     base: Column) -> Column:
    h = F.coalesce(humidity, F.lit(EST_DEFAULTS["humidity"]))
    w = F.coalesce(wind, F.lit(EST_DEFAULTS["wind_speed"]))
    t = F.coalesce(temp, F.lit(EST_DEFAULTS["temp"]))
    r = F.coalesce(rain, F.lit(EST_DEFAULTS["precipitation"]))
    humidity_factor = F.lit(1.0) + (h - F.lit(50.0)) * F.lit(0.004)
    wind_factor = F.greatest(F.lit(0.5), F.lit(1.0) - w * F.lit(0.06))
    rain_factor = F.greatest(F.lit(0.4), F.lit(1.0) - r * F.lit(0.3))
    temp_factor = F.lit(1.0) + F.greatest(F.lit(0.0), t - F.lit(35.0)) * F.lit(0.01)
    return base * lookup(HOURLY_FACTOR, hour, 1.0) * humidity_factor * wind_factor * rain_factor * temp_factor


def _finish(est: Column, base: Column, share: float, noise_seed: int | None) -> Column:
    if noise_seed is not None:
        est = est + F.randn(noise_seed) * base * F.lit(share)
    return F.greatest(F.lit(FLOOR_AQI), round_half_even(est, 1))


def estimate_aqi_current(ts: Column, humidity: Column, wind: Column, temp: Column, rain: Column,
                         base_aqi: Column, noise_seed: int | None = None) -> Column:
    """Base reading x seasonal x hourly x humidity x wind x rain x temperature."""
    base = base_aqi.cast("double") * lookup(SEASONAL_FACTOR, F.month(ts), 1.0)
    est = _weather_product(F.hour(ts), humidity, wind, temp, rain, base)
    return _finish(est, base_aqi.cast("double"), NOISE_SHARE_CURRENT, noise_seed)


def estimate_aqi_monthly(ts: Column, humidity: Column, wind: Column, temp: Column, rain: Column,
                         noise_seed: int | None = None) -> Column:
    """Monthly baseline x the same weather factors (no seasonal map)."""
    base = lookup(MONTHLY_AQI_BASELINE, F.month(ts))
    est = _weather_product(F.hour(ts), humidity, wind, temp, rain, base)
    return _finish(est, base, NOISE_SHARE_MONTHLY, noise_seed)


def scale_by_ratio(ref_value: Column, est: Column, base_aqi: Column) -> Column:
    """ref * est/base, one decimal; a null or zero reference gives null."""
    scale = F.when(base_aqi > 0, est / base_aqi).otherwise(F.lit(1.0))
    ok = ref_value.isNotNull() & (ref_value != 0)
    return F.when(ok, round_half_even(ref_value * scale, 1))


def scale_from_baseline(ts: Column, est: Column) -> dict[str, Column]:
    """pm25 from the monthly baseline scaled by est/monthly index; pm10 = 1.4 x."""
    month = F.month(ts)
    base_aqi = lookup(MONTHLY_AQI_BASELINE, month)
    scale = F.when(base_aqi > 0, est / base_aqi).otherwise(F.lit(1.0))
    pm = lookup(MONTHLY_PM25_BASELINE, month)
    return {"pm25": round_half_even(pm * scale, 1),
            "pm10": round_half_even(pm * scale * F.lit(PM10_PER_PM25), 1)}


def scale_by_pollutant_ratio(ref_value: Column, ref_aqi: Column, est: Column) -> Column:
    """(ref / ref index) x estimate, one decimal; null or zero inputs give null."""
    ok = ref_value.isNotNull() & ref_aqi.isNotNull() & (ref_aqi != 0)
    return F.when(ok, round_half_even(ref_value / ref_aqi * est, 1))
