"""Exact, distributed quantiles with linear interpolation (numpy/pandas rule).

Spark's exact ``percentile`` keeps every value of a group in one task; that
does not survive a key that holds a third of the data.  Here equal values are
counted first (partial aggregation, so a 0/1 column is two rows), the distinct
(key, value) rows are range-partitioned once, and the row counts per (key,
partition) - a small summary - say which partition holds a wanted rank.  Only
that slice is read again, and the rank is found by cumulated counts inside it.

So the work is one sort of the distinct values, whatever the ties, and no
slice is larger than a range partition.  Nulls and NaN take no part.

``wide_quantiles`` serves many columns of one table without unpivoting it: a
quantile sketch per column bounds the wanted ranks, and only the values inside
the bounds are looked at one by one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, staged_table


def lerp(lo: Column, hi: Column, t: Column) -> Column:
    """numpy's linear interpolation: a + (b-a)t below one half, b - (b-a)(1-t) above."""
    d = hi - lo
    return F.when(t >= F.lit(0.5), hi - d * (F.lit(1.0) - t)).otherwise(lo + d * t)


def _targets(counts: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Per key and prob: the two 0-based ranks around p*(n-1) and the fraction."""
    rows = []
    for i, p in enumerate(probs):
        pos = F.col("_n") * F.lit(float(p)) - F.lit(float(p))
        f = F.floor(pos).cast("long")
        rows.append(F.struct(F.lit(i).alias("pi"), F.lit(0).alias("side"), f.alias("rank"), (pos - f).alias("t")))
        rows.append(F.struct(F.lit(i).alias("pi"), F.lit(1).alias("side"),
                             F.least(f + 1, F.col("_n") - 1).alias("rank"), (pos - f).alias("t")))
    t = counts.filter(F.col("_n") > 0).select(*keys, F.explode(F.array(*rows)).alias("_g"))
    return t.select(*keys, "_g.pi", "_g.side", "_g.rank", "_g.t")


def ranked_slices(x: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct (keys, _x) with their count ``_c`` and range partition ``_p``, staged."""
    counted = x.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    ordered = counted.repartitionByRange(*[F.col(k) for k in keys], F.col("_x"))
    return staged_table(ordered.withColumn("_p", F.spark_partition_id()), "ranked")


def order_statistics(slices: DataFrame, keys: Sequence[str], targets: DataFrame) -> DataFrame:
    """``targets``: (keys, pi, side, rank).  Adds ``value``, the rank-th smallest (from 0)."""
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (key, partition)
    parts = (slices.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s"))
             .withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))))
    wanted = (targets.join(parts, list(keys))
              .filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_s")))
              .select(*keys, "pi", "side", "rank", "_p", "_before"))
    wanted = staged_table(wanted, "ranks")
    places = wanted.select(*keys, "_p", "_before").distinct()
    inside = Window.partitionBy(*keys, "_p").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    at = (slices.join(broadcast_if_small(places), [*keys, "_p"])
          .withColumn("_lo", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0))))
    got = (at.select(*keys, "_p", "_x", "_lo", "_c").join(broadcast_if_small(wanted.drop("_before")), [*keys, "_p"])
           .filter((F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_lo") + F.col("_c"))))
    return got.select(*keys, "pi", "side", "rank", F.col("_x").alias("value"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """One row per key: ``n`` (non-null count) and one column per prob."""
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    x = df.select(*keys, F.col(col).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    slices = ranked_slices(x, keys)
    counts = slices.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    tg = _targets(counts, keys, probs)
    stats = order_statistics(slices, keys, tg.select(*keys, "pi", "side", "rank"))
    both = tg.join(stats, [*keys, "pi", "side", "rank"])
    per = both.groupBy(*keys, "pi").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("_a"),
                                       F.max(F.when(F.col("side") == 1, F.col("value"))).alias("_b"),
                                       F.first("t").alias("_t"))
    per = per.withColumn("_q", lerp(F.col("_a"), F.col("_b"), F.col("_t")))
    wide = per.groupBy(*keys).agg(*[F.max(F.when(F.col("pi") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])
    return counts.withColumnRenamed("_n", "n").join(wide, list(keys), "left")


#: the sketch's rank error is a share of 1 / ACCURACY of the rows; distinct values that are brought to the driver
ACCURACY, COLLECTED = 10_000, 200_000


def _pick(values: Sequence[tuple[float, int]], rank: int) -> float:
    """The ``rank``-th smallest (from 0) of (value, count) pairs in order."""
    for value, count in values:
        if rank < count:
            return value
        rank -= count
    raise ValueError("rank beyond the values")


def wide_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY,
                   collected: int = COLLECTED) -> dict[str, tuple[int, list[float | None]]]:
    """Exact quantiles of each column over the whole table: {column: (non-null count, values)}.

    One wide aggregate gives each column's count and, from a mergeable sketch, bounds for the wanted
    ranks; a second one counts what lies below and inside the bounds; a third pass counts the distinct
    values inside, a few thousandths of the rows.  These come to the driver up to ``collected`` rows;
    beyond that their ranks are found by ``order_statistics``.  A table of up to ``accuracy`` rows needs no
    bounds.  A column without values gives nulls.
    """
    names = [f"_x{i}" for i in range(len(cols))]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    x = df.select(*[value(c).alias(n) for c, n in zip(cols, names)])
    margin = 3.0 / accuracy
    shares = [s for p in probs for s in (max(0.0, p - margin), min(1.0, p + margin))]
    seen = x.agg(*[F.count(n).alias(n) for n in names],
                 *[F.percentile_approx(n, shares, accuracy).alias(f"{n}_s") for n in names]).first()
    rank = lambda n, p: n * p - p
    # (column, prob) -> [low, high, rows below low, rows inside]; no bounds where the table is short
    spans = {}
    for n in names:
        for i in range(len(probs)) if seen[n] else ():
            bounded = seen[n] > accuracy
            spans[n, i] = [*(seen[f"{n}_s"][2 * i:2 * i + 2] if bounded else (-math.inf, math.inf)), 0, seen[n]]
    counts = [(k, s) for k, s in spans.items() if math.isfinite(s[0])]
    if counts:
        got = x.agg(*[f for (n, _), (low, high, *_) in counts for f in
                      (F.count_if(F.col(n) < F.lit(low)), F.count_if(F.col(n).between(F.lit(low), F.lit(high))))]).first()
        for at, ((n, i), s) in enumerate(counts):
            below, inside = got[2 * at], got[2 * at + 1]
            at_rank = math.floor(rank(seen[n], probs[i]))
            if below <= at_rank and min(at_rank + 1, seen[n] - 1) < below + inside:
                s[2:] = below, inside
            else:  # the sketch promises more than this; without bounds the answer is right all the same
                s[:] = -math.inf, math.inf, 0, seen[n]
    # Probs of one column with the same bounds are read once; a span of one value needs no reading.
    spread = sorted({(n, s[0], s[1]) for (n, _), s in spans.items() if s[0] < s[1]})
    inside: dict[tuple, list[tuple[float, int]]] = {}
    long = x.select(F.explode(F.filter(F.array(*[
        F.struct(F.lit(k).alias("item"), F.when(F.col(n).between(F.lit(low), F.lit(high)), F.col(n)).alias("_x"))
        for k, (n, low, high) in enumerate(spread)]), lambda v: v["_x"].isNotNull())).alias("v")).select("v.*") if spread else None
    wanted = {(n, i): [math.floor(rank(seen[n], probs[i])), min(math.floor(rank(seen[n], probs[i])) + 1, seen[n] - 1)] for n, i in spans}
    found: dict[tuple, float] = {}
    sizes = {(n, s[0], s[1]): s[3] for (n, _), s in spans.items()}
    if spread and sum(sizes[k] for k in spread) <= collected:
        for r in long.groupBy("item", "_x").count().collect():
            inside.setdefault(spread[r["item"]], []).append((r["_x"], r["count"]))
        for rows in inside.values():
            rows.sort()
    elif spread:
        slices = ranked_slices(long, ["item"])
        targets = [(spread.index((n, s[0], s[1])), i, side, wanted[n, i][side] - s[2])
                   for (n, i), s in spans.items() if s[0] < s[1] for side in (0, 1)]
        ranks = df.sparkSession.createDataFrame(targets, "item int, pi int, side int, rank long")
        found = {(spread[r["item"]][0], r["pi"], r["side"]): r["value"] for r in order_statistics(slices, ["item"], ranks).collect()}

    def at(n: str, i: int, side: int) -> float:
        low, high, below, _ = spans[n, i]
        if low == high:
            return low
        return found[n, i, side] if found else _pick(inside[n, low, high], wanted[n, i][side] - below)

    out = {}
    for c, n in zip(cols, names):
        values: list[float | None] = []
        for i, p in enumerate(probs):
            if not seen[n]:
                values.append(None)
                continue
            a, b = at(n, i, 0), at(n, i, 1)
            t = rank(seen[n], p) - wanted[n, i][0]
            values.append(b - (b - a) * (1.0 - t) if t >= 0.5 else a + (b - a) * t)
        out[c] = (seen[n], values)
    return out
