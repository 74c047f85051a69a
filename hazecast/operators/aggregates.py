"""Aggregations: hourly means, trends, summaries, station averages, metrics, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.aqi import aqi_category
from ..functions.labels import month_name
from ..functions.rounding import exact_mean, round_half_even


def mean_per_timestamp(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Several readings (locations, sensors) to one mean per key; exact decimal sum."""
    return df.groupBy(*keys).agg(exact_mean(F.col(value)).alias(out or value),
                                 F.count(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))).alias("n_readings"))


def daily_mean(df: DataFrame, keys: Sequence[str] = ("city",), ts: str = "timestamp", value: str = "aqi") -> DataFrame:
    day = F.to_date(F.col(ts)).cast("timestamp_ntz")  # day key as midnight timestamp
    g = df.groupBy(*keys, day.alias("date")).agg(exact_mean(F.col(value)).alias("avg_aqi"))
    return g.withColumn("category", aqi_category(F.col("avg_aqi")))


def hour_of_day_mean(df: DataFrame, keys: Sequence[str] = ("city",), ts: str = "timestamp", value: str = "aqi") -> DataFrame:
    g = df.groupBy(*keys, F.hour(F.col(ts)).alias("hour")).agg(exact_mean(F.col(value)).alias("avg_aqi"))
    return g.withColumn("category", aqi_category(F.col("avg_aqi")))


def month_mean(df: DataFrame, keys: Sequence[str] = ("city",), ts: str = "timestamp", value: str = "aqi",
               digits: int | None = None) -> DataFrame:
    g = df.groupBy(*keys, F.month(F.col(ts)).alias("month")).agg(exact_mean(F.col(value)).alias("avg_aqi"))
    if digits is not None:
        g = g.withColumn("avg_aqi", round_half_even(F.col("avg_aqi"), digits))
    g = g.withColumn("month_name", month_name(F.make_date(F.lit(2000), F.col("month"), F.lit(1))))
    return g.withColumn("category", aqi_category(F.col("avg_aqi")))


def forecast_day_summary(forecast: DataFrame, keys: Sequence[str] = ("city",), ts: str = "timestamp",
                         value: str = "predicted_aqi", days: int = 3) -> DataFrame:
    """Mean, min, max and category for the first ``days`` forecast dates per key."""
    from .ordering import first_n_dates
    d = forecast.withColumn("date", F.to_date(F.col(ts)).cast("timestamp_ntz"))
    first = first_n_dates(d, keys, "date", days)
    g = d.join(first, [*keys, "date"], "left_semi").groupBy(*keys, "date").agg(
        exact_mean(F.col(value)).alias("avg_aqi"), F.min(value).alias("min_aqi"), F.max(value).alias("max_aqi"))
    return g.withColumn("category", aqi_category(F.col("avg_aqi")))


def station_average(readings: DataFrame, keys: Sequence[str] = ("city",), value: str = "aqi") -> DataFrame:
    """Rounded mean over stations and the number of stations used."""
    return readings.groupBy(*keys).agg(
        round_half_even(exact_mean(F.col(value)), 0).alias("avg_aqi"),
        F.count(F.col(value)).alias("stations_used"))


def value_ranges(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[x for c in cols for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))])


def regression_metrics(df: DataFrame, keys: Sequence[str], y: str, yhat: str) -> DataFrame:
    """RMSE, MAE, R^2 per key from exact decimal sums (order-free)."""
    e = F.col(y) - F.col(yhat)
    dec = "decimal(38,12)"
    n = F.count(F.lit(1))
    sse = F.sum((e * e).cast(dec)).cast("double")
    sae = F.sum(F.abs(e).cast(dec)).cast("double")
    sy = F.sum(F.col(y).cast(dec)).cast("double")
    syy = F.sum((F.col(y) * F.col(y)).cast(dec)).cast("double")
    g = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*keys).agg(
        n.alias("n"), sse.alias("_sse"), sae.alias("_sae"), sy.alias("_sy"), syy.alias("_syy"))
    sst = F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("n")
    return g.select(*keys, "n", F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
                    (F.col("_sae") / F.col("n")).alias("mae"),
                    (F.lit(1.0) - F.col("_sse") / F.nullif(sst, F.lit(0.0))).alias("r2"))


def counted_stage(df: DataFrame, stage: str, audit: list | None) -> DataFrame:
    """``df``, whose rows are counted as they pass when it is written or read by an action; (stage,
    ``Observation``) goes to ``audit``.  Without an audit nothing is counted."""
    if audit is None:
        return df
    seen = Observation(f"rows of {stage}")
    audit.append((stage, seen))
    return df.observe(seen, F.count(F.lit(1)).alias("rows"))


def stage_rows(spark: SparkSession, audit: Sequence[tuple[str, Observation]]) -> DataFrame:
    """(stage, rows) of the stages that ``counted_stage`` counted; a row per stage of a plan."""
    return spark.createDataFrame([(stage, int(seen.get["rows"])) for stage, seen in audit], "stage string, rows long")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def mean_abs_contribution(contrib: DataFrame, features: Sequence[str], col: str = "contrib") -> DataFrame:
    """Mean absolute contribution per feature from an array column (``posexplode``)."""
    e = contrib.select(F.posexplode(F.col(col)).alias("pos", "c"))
    names = F.array(*[F.lit(f) for f in features])
    return (e.groupBy("pos").agg(F.avg(F.abs("c")).alias("shap_value"))
             .select(F.element_at(names, F.col("pos") + 1).alias("feature"), "shap_value"))


def importance_share(imp: DataFrame, value: str = "shap_value", width: int = 20) -> DataFrame:
    """Bar length: floor(value / max(value) * width); input has one row per feature."""
    from pyspark.sql import Window
    # one row per model feature: a bounded, feature-count-sized window
    mx = F.max(F.col(value)).over(Window.partitionBy())
    return imp.withColumn("bar", F.floor(F.col(value) / mx * F.lit(width)).cast("int"))
