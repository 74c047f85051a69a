"""Chronological splits and train-fitted transforms as DataFrame plans.

Fitted statistics (medians, quartiles, means) of all features come from wide
aggregates, one row in and one row out; no row is multiplied by the features.
They are a model's parameters (a few numbers per feature) and are applied as
literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import wide_quantiles
from ..operators.windows import global_row_number
from ..session import broadcast_if_small


def chronological_split(df: DataFrame, frac: float = 0.8, keys: Sequence[str] = ("city",), ts: str = "timestamp",
                        order: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """First int(frac * n) rows by time per key go to train, the rest to test."""
    order = list(order or [ts])
    r = global_row_number(df, keys, ts, order, out="_rn")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(broadcast_if_small(n), list(keys))
    cut = F.floor(F.col("_n") * F.lit(float(frac)))
    train = r.filter(F.col("_rn") <= cut).drop("_rn", "_n")
    test = r.filter(F.col("_rn") > cut).drop("_rn", "_n")
    return train, test


def tail_validation_split(train: DataFrame, frac: float = 0.2, keys: Sequence[str] = ("city",),
                          ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Last int(frac * n) rows of the training part become validation."""
    r = global_row_number(train, keys, ts, [ts], out="_rn")
    n = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(broadcast_if_small(n), list(keys))
    v = F.floor(F.col("_n") * F.lit(float(frac)))
    fit = r.filter(F.col("_rn") <= F.col("_n") - v).drop("_rn", "_n")
    val = r.filter(F.col("_rn") > F.col("_n") - v).drop("_rn", "_n")
    return fit, val


def fit_quantiles(train: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> dict[str, dict]:
    """Exact quantiles per feature by name; null where a feature has no value."""
    return {c: dict(zip(names, values)) for c, (_, values) in wide_quantiles(train, cols, probs).items()}


def fit_moments(train: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """Mean and population standard deviation per feature, by one aggregate."""
    number = lambda c: F.col(c).cast("double")
    row = train.agg(*[f(number(c)) for c in cols for f in (F.avg, F.stddev_pop)]).first()
    return {c: {"mean": row[2 * i], "std": row[2 * i + 1]} for i, c in enumerate(cols)}


def _apply(df: DataFrame, params: dict[str, dict], cols: Sequence[str], fn) -> DataFrame:
    """Transform with the fitted parameters as literals (constant-folded, codegen-friendly)."""
    def lit(v):
        return F.lit(None).cast("double") if v is None else F.lit(float(v))
    # a feature with no fitted value (e.g. an empty training split) gets null statistics
    return df.withColumns({c: fn(F.col(c), {n: lit(v) for n, v in params[c].items()}) for c in cols})


def median_impute(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    med = fit_quantiles(train, cols, [0.5], ["median"])
    return _apply(df, med, cols, lambda c, s: F.coalesce(c.cast("double"), s["median"]))


def robust_scale(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - median) / IQR with IQR 0 -> 1 (sklearn ``RobustScaler`` defaults)."""
    q = fit_quantiles(train, cols, [0.25, 0.5, 0.75], ["q25", "median", "q75"])
    q = {c: {"median": s["median"], "iqr": None if s["median"] is None else s["q75"] - s["q25"]} for c, s in q.items()}

    def fn(c: Column, s):
        scale = F.when(s["iqr"] == 0, F.lit(1.0)).otherwise(s["iqr"])
        return (c.cast("double") - s["median"]) / scale
    return _apply(df, q, cols, fn)


def standard_scale(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std, std 0 -> 1 (sklearn ``StandardScaler``)."""
    st = fit_moments(train, cols)

    def fn(c: Column, s):
        scale = F.when(s["std"] == 0, F.lit(1.0)).otherwise(s["std"])
        return (c.cast("double") - s["mean"]) / scale
    return _apply(df, st, cols, fn)


def _number(v: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if v is None else f"CAST('{float(v)!r}' AS DOUBLE)"


def impute_stage(train: DataFrame, cols: Sequence[str], prefix: str = "in_") -> SQLTransformer:
    """Median imputation fitted on ``train`` as a stage that a saved pipeline keeps: adds
    ``prefix`` + column for each of ``cols`` and leaves the columns themselves as they are."""
    med = fit_quantiles(train, cols, [0.5], ["median"])
    out = [f"coalesce(CAST(`{c}` AS DOUBLE), {_number(med[c]['median'])}) AS `{prefix}{c}`" for c in cols]
    return SQLTransformer(statement=f"SELECT *, {', '.join(out)} FROM __THIS__")


def scale_stage(imputed: DataFrame, cols: Sequence[str], prefix: str = "in_", to: str = "scaled_") -> SQLTransformer:
    """Standard scaling (population std, 0 -> 1) fitted on the imputed columns, as a stage."""
    st = fit_moments(imputed, [f"{prefix}{c}" for c in cols])
    out = []
    for c in cols:
        s = st[f"{prefix}{c}"]
        out.append(f"(`{prefix}{c}` - {_number(s['mean'])}) / {_number(s['std'] or 1.0)} AS `{to}{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(out)} FROM __THIS__")
