"""Sort, limit and top-k operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_by_time(df: DataFrame, ts: str = "timestamp", keys: Sequence[str] = ()) -> DataFrame:
    """Total order (range-partitioned sort); use only where order is observable."""
    return df.orderBy(*keys, ts)


def latest_row(df: DataFrame, ts: str = "timestamp", cols: Sequence[str] | None = None) -> DataFrame:
    """Newest row overall: projection + ORDER BY DESC + LIMIT 1 (TakeOrderedAndProject)."""
    d = df.select(*(cols or df.columns)) if cols else df
    if cols and ts not in cols:
        d = df.select(*cols, ts)
    return d.orderBy(F.col(ts).desc()).limit(1)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    st = F.struct(F.col(ts).alias("_ts"), *[F.col(c) for c in cols])
    return df.groupBy(*keys).agg(F.max(st).alias("_l")).select(*keys, F.col("_l._ts").alias(ts),
                                                                *[F.col("_l")[c].alias(c) for c in cols])


def future_head(df: DataFrame, now: Column, ts: str = "timestamp", n: int = 72, keys: Sequence[str] = ("city",),
                by: str = "hours") -> DataFrame:
    """Rows after ``now``: those within ``n`` hours, or (``by="rows"``) the first ``n`` per key."""
    fut = df.filter(F.col(ts) > now)
    if by == "hours":
        return fut.filter(F.col(ts) <= now + F.expr(f"INTERVAL {int(n)} HOURS"))
    w = Window.partitionBy(*keys).orderBy(ts)
    return fut.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_n_dates(df: DataFrame, keys: Sequence[str], date: str, n: int) -> DataFrame:
    """Distinct dates, first ``n`` per key (distinct pre-aggregates; window over dates only)."""
    d = df.select(*keys, date).distinct()
    w = Window.partitionBy(*keys).orderBy(date)
    return d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_k(df: DataFrame, by: str, k: int, desc: bool = True, tiebreak: Sequence[str] = ()) -> DataFrame:
    o = F.col(by).desc() if desc else F.col(by).asc()
    return df.orderBy(o, *tiebreak).limit(k)


def best_by_min(df: DataFrame, metric: str, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Row with the smallest ``metric`` (``min_by``), optionally among a subset."""
    d = df.filter(where) if where is not None else df
    st = F.struct(*[F.col(c) for c in cols])
    best = d.agg(F.min_by(st, F.col(metric)).alias("_b")).filter(F.col("_b").isNotNull())  # empty input: no row
    return best.select(*[F.col("_b")[c].alias(c) for c in cols])
