"""Filters and predicates: IQR fences, validity, horizons, alerts, column gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aqi import aqi_category
from ..session import broadcast_if_small
from .quantiles import exact_quantiles

# Fence multipliers and gates.
IQR_MULTIPLIER = {"aqi": 3}
DEFAULT_IQR_MULTIPLIER = 5
OUTLIER_MIN_COUNT = 20
IMPUTE_MIN_COUNT = 10
ALERT_THRESHOLD = 150


def iqr_fences(df: DataFrame, keys: Sequence[str], col: str, k: float) -> DataFrame:
    q = exact_quantiles(df, keys, col, [0.25, 0.75], names=["_q1", "_q3"])
    iqr = F.col("_q3") - F.col("_q1")
    return q.select(*keys, F.col("n").alias("_n"), (F.col("_q1") - F.lit(k) * iqr).alias("_lo"),
                    (F.col("_q3") + F.lit(k) * iqr).alias("_hi"))


def iqr_filter(df: DataFrame, keys: Sequence[str], col: str, k: float | None = None,
               min_count: int = OUTLIER_MIN_COUNT, nulls: str = "drop") -> DataFrame:
    """Keep rows inside [Q1 - k IQR, Q3 + k IQR] (inclusive) when the key has more
    than ``min_count`` values.  ``nulls="drop"`` reproduces pandas ``between``
    (null is outside); ``"keep"`` keeps null rows."""
    if not keys:
        raise ValueError("iqr_filter needs a key (e.g. city)")
    k = k if k is not None else IQR_MULTIPLIER.get(col, DEFAULT_IQR_MULTIPLIER)
    j = df.join(broadcast_if_small(iqr_fences(df, keys, col, k)), list(keys), "left")  # one row per key
    inside = F.col(col).between(F.col("_lo"), F.col("_hi"))
    if nulls == "keep":
        inside = inside | F.col(col).isNull()
    gate = F.coalesce(F.col("_n"), F.lit(0)) > F.lit(min_count)
    return j.filter(~gate | F.coalesce(inside, F.lit(False))).drop("_n", "_lo", "_hi")


def valid_measurement(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value >= 0)


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def alerts(df: DataFrame, aqi: str = "aqi", threshold: float = ALERT_THRESHOLD) -> DataFrame:
    return df.filter(F.col(aqi) > threshold).withColumn("category", aqi_category(F.col(aqi)))


def feed_ok(status: Column, aqi_text: Column) -> Column:
    """Station feed usable: status ok and a numeric index above zero."""
    v = aqi_text.try_cast("double")
    return (status == F.lit("ok")) & v.isNotNull() & (v > 0)


def nonnull_counts(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One aggregate pass: non-null count per column (inputs to the column gates)."""
    return df.groupBy(*keys).agg(*[F.count(F.col(c)).alias(c) for c in cols])


def usable_columns(df: DataFrame, cols: Sequence[str], min_nonnull: int) -> list[str]:
    """Driver-side choice of columns from a one-row count aggregate (a schema decision)."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return []
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in present]).first()
    return [c for c in present if row[c] > min_nonnull]
