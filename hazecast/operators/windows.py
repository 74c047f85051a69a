"""Ordered-series windows that stay distributed when one key holds most rows.

A plain ``Window.partitionBy(city).orderBy(ts)`` puts a whole city in one task
(and a global series in ``Exchange SinglePartition``).  The plans here split a
series into time buckets and blocks:

* ``global_row_number``: rows per (key, bucket) are counted, the small summary
  is cumulated, and an in-bucket ``row_number`` is offset by it.
* ``halo_window``: rows are grouped into blocks of ``block_rows`` consecutive
  rows; the last ``reach`` rows of a block are copied into the next block, so
  a lag or a rows frame of up to ``reach`` rows is exact inside each block.
* ``carry_last`` / ``running_sum``: the value in a bucket is completed from a
  per-bucket summary carried across buckets (forward fill, as-of, prefix sums).

All are exact; property tests compare them with the single-window result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small

DEFAULT_BLOCK_ROWS = 8192


def bucket_of(ts: Column, unit: str = "day") -> Column:
    """Integer time bucket of a TIMESTAMP_NTZ (or DATE) column."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    if unit == "day":
        return day
    if unit == "hour":
        return day * 24 + F.hour(ts)
    if unit == "month":
        return (F.year(ts) * 12 + F.month(ts)).cast("long")
    raise ValueError(unit)


def _join_keys(keys: Sequence[str], extra: str) -> list[str]:
    return [*keys, extra]


def global_row_number(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
                      unit: str = "day", out: str = "_rn") -> DataFrame:
    """1-based position of each row in its key's series ordered by ``order`` (starts with ``ts``)."""
    b = df.withColumn("_bk", bucket_of(F.col(ts), unit))
    counts = b.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bk", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    j = b.join(offsets, _join_keys(keys, "_bk"))
    inb = Window.partitionBy(*keys, "_bk").orderBy(*order)
    return j.withColumn(out, F.col("_off") + F.row_number().over(inb)).drop("_off", "_bk")


def halo_window(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
                columns: dict[str, Callable[[Window], Column]], reach: int,
                block_rows: int = DEFAULT_BLOCK_ROWS, unit: str = "day") -> DataFrame:
    """Apply row-frame window expressions of look-back ``reach`` in halo blocks."""
    if reach > block_rows:
        raise ValueError("reach must not exceed block_rows")
    r = global_row_number(df, keys, ts, order, unit)
    r = r.withColumn("_blk", F.floor((F.col("_rn") - 1) / F.lit(block_rows)))
    pos = (F.col("_rn") - 1) % F.lit(block_rows)
    home = r.withColumn("_halo", F.lit(False))
    halo = (r.filter(pos >= F.lit(block_rows - reach))
             .withColumn("_blk", F.col("_blk") + 1).withColumn("_halo", F.lit(True)))
    u = home.unionByName(halo)
    w = Window.partitionBy(*keys, "_blk").orderBy("_rn")
    out = u.withColumns({name: fn(w) for name, fn in columns.items()})
    return out.filter(~F.col("_halo")).drop("_blk", "_halo", "_rn")


def plain_window(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 columns: dict[str, Callable[[Window], Column]]) -> DataFrame:
    """Reference form: one window per key (used for tests and small inputs)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({name: fn(w) for name, fn in columns.items()})


def carry_last(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
               values: Sequence[str], unit: str = "day", suffix: str = "") -> DataFrame:
    """For each row, the last non-null value of each column at or before it."""
    b = df.withColumn("_bk", bucket_of(F.col(ts), unit))
    w_in = Window.partitionBy(*keys, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({f"_in_{v}": F.last(F.col(v), ignorenulls=True).over(w_in) for v in values})
    summ = b.groupBy(*keys, "_bk").agg(*[
        F.max(F.when(F.col(v).isNotNull(), F.struct(*[F.col(o) for o in order], F.col(v).alias("_v"))))
         .alias(f"_s_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    carried = summ.select(*keys, "_bk", *[
        F.last(F.col(f"_s_{v}")["_v"], ignorenulls=True).over(before).alias(f"_c_{v}") for v in values])
    j = b.join(carried, _join_keys(keys, "_bk"), "left")
    j = j.withColumns({f"{v}{suffix}": F.coalesce(F.col(f"_in_{v}"), F.col(f"_c_{v}")) for v in values})
    return j.drop("_bk", *[f"_in_{v}" for v in values], *[f"_c_{v}" for v in values])


def first_non_null(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: the earliest non-null value of each column."""
    return df.groupBy(*keys).agg(*[
        F.min(F.when(F.col(v).isNotNull(), F.struct(*[F.col(o) for o in order], F.col(v).alias("_v"))))["_v"]
         .alias(f"_first_{v}") for v in values])


def fill_forward_backward(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
                          values: Sequence[str], unit: str = "day") -> DataFrame:
    """Forward fill, then backward fill of the leading nulls (pandas ``ffill().bfill()``)."""
    if not keys:
        raise ValueError("fill_forward_backward needs a series key (e.g. city)")
    f = carry_last(df, keys, ts, order, values, unit)
    first = first_non_null(df, keys, order, values)
    j = f.join(broadcast_if_small(first), list(keys), "left")
    j = j.withColumns({v: F.coalesce(F.col(v), F.col(f"_first_{v}")) for v in values})
    return j.drop(*[f"_first_{v}" for v in values])


def running_sum(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
                values: dict[str, Column], unit: str = "day") -> DataFrame:
    """Inclusive running totals per key, computed per bucket plus carried bucket totals."""
    b = df.withColumn("_bk", bucket_of(F.col(ts), unit)).withColumns({f"_x_{k}": v for k, v in values.items()})
    w_in = Window.partitionBy(*keys, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({f"_in_{k}": F.sum(F.col(f"_x_{k}")).over(w_in) for k in values})
    summ = b.groupBy(*keys, "_bk").agg(*[F.sum(F.col(f"_x_{k}")).alias(f"_t_{k}") for k in values])
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    carried = summ.select(*keys, "_bk", *[F.sum(F.col(f"_t_{k}")).over(before).alias(f"_c_{k}") for k in values])
    j = b.join(carried, _join_keys(keys, "_bk"), "left")
    zero = {k: F.coalesce(F.col(f"_in_{k}"), F.lit(0)) + F.coalesce(F.col(f"_c_{k}"), F.lit(0)) for k in values}
    j = j.withColumns(zero)
    return j.drop("_bk", *[f"_x_{k}" for k in values], *[f"_in_{k}" for k in values], *[f"_c_{k}" for k in values])


def _rows_frame(n: int, include_current: bool) -> tuple[int, int]:
    return (-(n - 1), 0) if include_current else (-n, -1)


def series_row_features(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], value: str,
                        lags: Sequence[int] = (), rolls: Sequence[int] = (), min_periods: int = 24,
                        include_current: bool = True, change_rate: str | None = None, change_digits: int = 2,
                        scale: int = 6, block_rows: int = DEFAULT_BLOCK_ROWS, unit: str = "day",
                        method: str = "halo") -> DataFrame:
    """Row-position lags, rolling means and the first difference in one pass.

    * ``{value}_lag_{n}h``: the value ``n`` rows earlier.
    * ``{value}_rolling_{n}h``: mean over the last ``n`` rows (nulls skipped),
      null while fewer than ``min_periods`` values are present; the frame ends
      at the current row or the row before (``include_current``).  Sums are
      exact decimals.
    * ``change_rate``: value minus the previous row's value, null -> 0, rounded.
    """
    from ..functions.rounding import round_half_even

    v = F.col(value)
    dec = v.cast(f"decimal(18,{scale})")
    cols: dict[str, Callable[[Window], Column]] = {}
    reach = 1
    for n in lags:
        cols[f"{value}_lag_{n}h"] = (lambda w, n=n: F.lag(v, n).over(w))
        reach = max(reach, n)
    for n in rolls:
        lo, hi = _rows_frame(n, include_current)

        def roll(w, lo=lo, hi=hi):
            fw = w.rowsBetween(lo, hi)
            cnt = F.count(v).over(fw)
            return F.when(cnt >= min_periods, F.sum(dec).over(fw).cast("double") / cnt)
        cols[f"{value}_rolling_{n}h"] = roll
        reach = max(reach, n)
    if change_rate:
        cols[change_rate] = (lambda w: round_half_even(F.coalesce(v - F.lag(v, 1).over(w), F.lit(0.0)),
                                                       change_digits))
    if method == "plain":
        return plain_window(df, keys, order, cols)
    return halo_window(df, keys, ts, order, cols, reach=reach, block_rows=max(block_rows, reach), unit=unit)
