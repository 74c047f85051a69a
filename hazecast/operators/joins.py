"""Joins: hourly alignment, as-of lag, range mean, reference row, history features.

As-of and range joins are planned as union + carry over time buckets (see
``windows``): no pair of rows is ever materialised, and the work is
O(n log n) per key with no single-partition step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import DIGITS, as_decimal
from ..session import broadcast_if_small
from .windows import bucket_of, carry_last, running_sum


def _zero() -> Column:
    """A sum's beginning, in the type of ``as_decimal``."""
    return F.lit(0).cast(f"decimal(38,{DIGITS})")


def align_hourly(weather: DataFrame, readings: DataFrame, keys: Sequence[str] = ("city", "timestamp")) -> DataFrame:
    """Inner equi-join on (city, hour); AQE chooses broadcast or sort-merge at run time."""
    return weather.join(readings, list(keys), "inner")


def _hours(h: int) -> Column:
    return F.expr(f"INTERVAL {int(h)} HOURS")


def asof_value(probes: DataFrame, history: DataFrame, keys: Sequence[str], probe_ts: str, hist_ts: str,
               value: str, hours: int, default: Column | None = None, out: str | None = None,
               unit: str = "day") -> DataFrame:
    """For each probe at t: ``value`` of the last history row with ts <= t - hours.

    A matched row whose value is null stays null; no match gives ``default``.
    """
    out = out or f"{value}_asof_{hours}h"
    pcols = probes.columns
    p = probes.select(*keys, (F.col(probe_ts) - _hours(hours)).alias("_t"), F.lit(1).alias("_kind"),
                      F.lit(None).cast(history.select(F.struct(F.col(hist_ts).alias("ts"), F.col(value).alias("v")))
                                       .schema[0].dataType).alias("_m"),
                      F.struct(*[F.col(c) for c in pcols]).alias("_p"))
    h = history.select(*keys, F.col(hist_ts).alias("_t"), F.lit(0).alias("_kind"),
                       F.struct(F.col(hist_ts).alias("ts"), F.col(value).alias("v")).alias("_m"),
                       F.lit(None).cast(p.schema["_p"].dataType).alias("_p"))
    c = carry_last(p.unionByName(h), keys, "_t", ["_t", "_kind"], ["_m"], unit)
    res = c.filter(F.col("_kind") == 1)
    matched = F.col("_m")
    val = F.when(matched.isNull(), default if default is not None else F.lit(None)).otherwise(matched["v"])
    return res.select(*[F.col("_p")[x].alias(x) for x in pcols], val.alias(out))


def range_mean(probes: DataFrame, history: DataFrame, keys: Sequence[str], probe_ts: str, hist_ts: str,
               value: str, hours: int, end_hours: int = 1, default: Column | None = None,
               out: str | None = None, unit: str = "day") -> DataFrame:
    """Mean of ``value`` over history rows with t - hours <= ts <= t - end_hours.

    Planned with exact prefix sums: (S(<= hi) - S(< lo)) / (N(<= hi) - N(< lo)).
    An empty window gives ``default``; a window with rows but only null or NaN values
    gives null.
    """
    out = out or f"{value}_range_{hours}h"
    pcols = probes.columns
    dec = as_decimal(F.col(value))
    cum = running_sum(history.select(*keys, hist_ts, value), keys, hist_ts, [hist_ts],
                      {"s": F.coalesce(dec, _zero()), "n": dec.isNotNull().cast("long"), "r": F.lit(1).cast("long")}, unit)
    cum_t = F.struct(F.col("s"), F.col("n"), F.col("r"))
    h = cum.select(*keys, F.col(hist_ts).alias("_t"), F.lit(0).alias("_kind"), cum_t.alias("_m"),
                   F.lit(None).cast("timestamp_ntz").alias("_pt"))
    mt = h.schema["_m"].dataType
    hi = probes.select(*keys, (F.col(probe_ts) - _hours(end_hours)).alias("_t"), F.lit(1).alias("_kind"),
                       F.lit(None).cast(mt).alias("_m"), F.col(probe_ts).cast("timestamp_ntz").alias("_pt"))
    lo = probes.select(*keys, (F.col(probe_ts) - _hours(hours)).alias("_t"), F.lit(-1).alias("_kind"),
                       F.lit(None).cast(mt).alias("_m"), F.col(probe_ts).cast("timestamp_ntz").alias("_pt"))
    c = carry_last(h.unionByName(hi).unionByName(lo), keys, "_t", ["_t", "_kind"], ["_m"], unit)
    c = c.filter(F.col("_kind") != 0)
    g = c.groupBy(*keys, "_pt").agg(
        F.max(F.when(F.col("_kind") == 1, F.col("_m"))).alias("_a"),
        F.max(F.when(F.col("_kind") == -1, F.col("_m"))).alias("_b"))
    s = F.coalesce(F.col("_a.s"), _zero()) - F.coalesce(F.col("_b.s"), _zero())
    n = F.coalesce(F.col("_a.n"), F.lit(0)) - F.coalesce(F.col("_b.n"), F.lit(0))
    r = F.coalesce(F.col("_a.r"), F.lit(0)) - F.coalesce(F.col("_b.r"), F.lit(0))
    mean = (F.when(r == 0, default if default is not None else F.lit(None))
             .when(n == 0, F.lit(None)).otherwise(s.cast("double") / n))
    g = g.select(*keys, F.col("_pt"), mean.alias(out))
    return probes.join(g.withColumnRenamed("_pt", probe_ts), [*keys, probe_ts], "left")


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Newest row per key (``max_by``: one partial aggregate, no sort)."""
    st = F.struct(*[F.col(c) for c in cols])
    return df.groupBy(*keys).agg(F.max_by(st, F.col(ts)).alias("_l")).select(*keys, *[F.col("_l")[c].alias(c) for c in cols])


def with_reference_row(df: DataFrame, ref: DataFrame, keys: Sequence[str] = ("city",)) -> DataFrame:
    """Attach the (one) reference reading of each key to every row of that key."""
    return df.join(broadcast_if_small(ref), list(keys), "left")


def _swept(points: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Rows of kind 0 are history (``_m``: struct of time and value, ``_s``, ``_n``: its addend and 1 if it has
    one); for the others ``_m``, ``_s``, ``_n``, ``_r`` become the last history row and the sums and rows of all
    history at or before (kind 1) or before (kind -1) their time.  In a bucket by a window, across buckets
    by a carried summary of one row per (key, bucket)."""
    b = points.withColumn("_bk", bucket_of(F.col("_t"), unit)).withColumn("_r", (F.col("_kind") == 0).cast("long"))
    order = [F.col("_t"), F.col("_kind")]
    upto = Window.partitionBy(*keys, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ("_s", "_n", "_r")
    # The rows are exchanged once, for the window; the summary leaves the tasks as a row per (key, bucket).
    inner = b.withColumns({"_im": F.last("_m", ignorenulls=True).over(upto), **{f"_i{c}": F.sum(c).over(upto) for c in sums}})
    total = b.groupBy(*keys, "_bk").agg(F.max("_m").alias("_tm"), *[F.sum(c).alias(f"_t{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select(*keys, "_bk", F.last("_tm", ignorenulls=True).over(before).alias("_cm"),
                           *[F.sum(f"_t{c}").over(before).alias(f"_c{c}") for c in sums])
    j = inner.where("_kind <> 0").join(carried, [*keys, "_bk"], "left")
    return j.withColumns({"_m": F.coalesce("_im", "_cm"),
                          **{c: F.coalesce(f"_i{c}", zero) + F.coalesce(f"_c{c}", zero)
                             for c, zero in zip(sums, (_zero(), F.lit(0), F.lit(0)))}})


def history_features(probes: DataFrame, history: DataFrame, keys: Sequence[str], ts: str, value: str,
                     lags: Sequence[int] = (), rolls: Sequence[int] = (), default: str | None = None,
                     prefix: str | None = None, end_hours: int = 1, unit: str = "day") -> DataFrame:
    """Time-based lags and range means for each probe (keys, ts), all of them by one sweep.

    A lag needs the last history row at one time, a range mean the sums at its two ends: each probe
    becomes a point for each of these times, and points and history go through one union, one
    exchange by (key, bucket) and one window.  A lag's row without a value stays null; a range with rows
    but without a value (null, NaN) is null.  ``default``: name of a probe column used when the history
    has no row (as-of) or the range is empty; the probes must be unique per (keys, ts).
    """
    prefix, keys = prefix or value, list(keys)
    if not lags and not rolls:
        return probes
    # (name, hours back, kind): kind -1 leaves out what lies at the time itself
    ends = [(f"lag{n}", n, 1) for n in lags] + [(f"from{n}", n, -1) for n in rolls] + [("to", end_hours, 1)] * bool(rolls)
    dec = as_decimal(F.col(value))
    rows = history.select(*keys, F.col(ts).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_end"),
                          F.lit(None).cast("timestamp_ntz").alias("_pt"), F.struct(F.col(ts).alias("ts"), F.col(value).alias("v")).alias("_m"),
                          F.coalesce(dec, _zero()).alias("_s"), dec.isNotNull().cast("long").alias("_n"))
    each = F.array(*[F.struct((F.col(ts) - _hours(h)).alias("_t"), F.lit(kind).alias("_kind"), F.lit(name).alias("_end"))
                     for name, h, kind in ends])
    points = (probes.select(*keys, F.col(ts).cast("timestamp_ntz").alias("_pt"), F.explode(each).alias("_e"))
              .select(*keys, "_e._t", "_e._kind", "_e._end", "_pt", F.lit(None).cast(rows.schema["_m"].dataType).alias("_m"),
                      _zero().alias("_s"), F.lit(0).cast("long").alias("_n")))
    got = _swept(rows.unionByName(points), keys, unit)
    state = F.struct("_m", "_s", "_n", "_r")
    wide = got.groupBy(*keys, "_pt").agg(*[F.max(F.when(F.col("_end") == name, state)).alias(f"_{name}") for name, _, _ in ends])
    out = probes.join(wide.withColumnRenamed("_pt", ts), [*keys, ts], "left")
    missing = F.col(default) if default else F.lit(None).cast("double")
    for n in lags:
        m = F.col(f"_lag{n}._m")
        out = out.withColumn(f"{prefix}_lag_{n}h", F.when(m.isNull(), missing).otherwise(m["v"]))
    for n in rolls:
        a, b = F.col("_to"), F.col(f"_from{n}")
        count = a["_n"] - b["_n"]
        mean = F.when(a["_r"] - b["_r"] == 0, missing).when(count != 0, (a["_s"] - b["_s"]).cast("double") / count)
        out = out.withColumn(f"{prefix}_rolling_{n}h", mean)
    return out.drop(*[f"_{name}" for name, _, _ in ends])
