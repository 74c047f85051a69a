"""The leakage-controlled preprocessing plan (the flagship feature build).

keep-last -> IQR fences (aqi x3, pm25 x5, pm10 x5, sequential) -> KNN imputation
of pollutants -> forward/backward fill of weather -> calendar, cyclical, season
-> lags and rolling means -> interactions and flags -> drop rows without lag-72.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import weather as wx
from ..operators.aggregates import counted_stage
from ..operators.filters import IMPUTE_MIN_COUNT, drop_null, iqr_filter, usable_columns
from ..operators.knn import knn_impute
from ..operators.windows import fill_forward_backward, series_row_features
from ..session import staged_table

# Column groups and the 27 model inputs in model order.
OUTLIER_COLS = ["aqi", "pm25", "pm10"]
POLLUTANT_COLS = ["pm25", "pm10", "no2", "o3", "co", "so2"]
WEATHER_FILL_COLS = ["temp", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction"]
FEATURE_COLS = [
    "temp", "feels_like", "humidity", "pressure", "wind_speed", "wind_direction",
    "precipitation", "weather_code",
    "hour_sin", "hour_cos", "month_sin", "month_cos",
    "dayofweek", "is_weekend", "is_rush_hour", "season",
    "is_hot", "is_cold", "is_calm_wind", "is_strong_wind", "is_stagnant",
    "temp_humidity", "wind_humidity",
    "aqi_lag_72h", "aqi_lag_96h",
    "aqi_rolling_72h", "aqi_rolling_96h",
]
TARGET = "aqi"
#: arguments that reproduce the reference: the current row is in its own mean, null rows go
PARITY = {"include_current": True, "nulls": "drop"}


def keep_last(df: DataFrame, keys: Sequence[str], seq: str = "ingest_seq") -> DataFrame:
    """One row per key, the last written (largest ``seq``): one aggregate, no sort.

    A row without ``seq`` comes before all others; equal ones are told apart by a hash of their
    values, so the choice does not depend on the partitioning."""
    others = [c for c in df.columns if c not in keys]
    st = F.struct(*[F.col(c) for c in others])
    last = F.struct(F.col(seq).isNotNull(), F.col(seq), F.xxhash64(*others))
    return df.groupBy(*keys).agg(F.max_by(st, last).alias("_k")).select(*keys, "_k.*")


def preprocess(df: DataFrame, keys: Sequence[str] = ("city",), ts: str = "timestamp",
               include_current: bool = False, nulls: str = "keep", cyclical_digits: int | None = 9,
               knn_k: int = 5, method: str = "halo", checkpoint: bool = True,
               audit: list | None = None) -> DataFrame:
    """By default the rolling means end before the current row, so that the target is no input, and
    rows without a value pass the fences; ``PARITY`` has the reference's choices.

    The rows left by keep-last are staged once; the fences of each filter are staged rows per key,
    joined to them.  ``audit``: if given, (stage, ``Observation``) pairs are appended; their counts are
    there once the result has been written or read by an action."""
    keys = list(keys)
    out = counted_stage(keep_last(counted_stage(df, "input", audit), [*keys, ts]), "dedup", audit)
    if checkpoint:
        out = staged_table(out, "preprocess")
    for c in OUTLIER_COLS:
        if c in out.columns:
            out = counted_stage(iqr_filter(out, keys, c, nulls=nulls), f"outliers_{c}", audit)
    pollutants = usable_columns(out, POLLUTANT_COLS, IMPUTE_MIN_COUNT)
    if pollutants:
        out = knn_impute(out, keys, ts, pollutants, k=knn_k)
    fill = [c for c in WEATHER_FILL_COLS if c in out.columns]
    if fill:
        out = fill_forward_backward(out, keys, ts, [ts], fill)
    t = F.col(ts)
    out = out.withColumns(cal.calendar_parts(t))
    hs, hc = cal.cyclical(F.col("hour"), 24, cyclical_digits)
    ms, mc = cal.cyclical(F.col("month"), 12, cyclical_digits)
    out = out.withColumns({"hour_sin": hs, "hour_cos": hc, "month_sin": ms, "month_cos": mc,
                           "season": cal.season(F.col("month"))})
    out = series_row_features(out, keys, ts, [ts], TARGET, lags=(72, 96), rolls=(72, 96), min_periods=24,
                              include_current=include_current, method=method)
    temp, hum, wind = F.col("temp"), F.col("humidity"), F.col("wind_speed")
    out = out.withColumns({**wx.interactions(temp, hum, wind), "is_stagnant": wx.is_stagnant(wind, hum),
                           **wx.weather_flags(temp, wind)})
    return counted_stage(drop_null(out, ["aqi_lag_72h"]), "final", audit)


def select_features(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The model inputs that exist, in model order (plus ``extra`` columns first)."""
    return df.select(*extra, *[c for c in FEATURE_COLS if c in df.columns])
