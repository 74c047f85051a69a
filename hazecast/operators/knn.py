"""Exact k-nearest-neighbour imputation (nan-Euclidean distance, uniform mean).

Semantics (the published definition of the KNN imputer): for a row with a
missing value in column c, donors are rows of the same key with c present;
distance^2 = (ncols / shared) * sum over shared present coordinates of the
squared difference; the k nearest donors (ties: earlier timestamp first)
give the mean of their c values; a row with no donor at a defined distance
gets the column mean.

Plan: per key, receivers (rows with a null) and donors are dealt by hash into
tiles of about ``RECEIVER_TILE`` and ``DONOR_TILE`` rows.  Every pair of tiles
of a key is one group, which finds its k nearest donors per receiver and column
with numpy, so a task holds one tile pair whatever the key's size; a window
over (receiver, column) merges k rows per tile pair.  Nothing passes through
the driver, and no receiver-donor pair is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rounding import exact_mean
from ..session import broadcast_if_small, staged_table

#: rows of a tile, about; a distance matrix has their product
RECEIVER_TILE, DONOR_TILE = 512, 8192


def _tile_topk(pdf: pd.DataFrame, keys: list[str], ts: str, cols: list[str], k: int) -> pd.DataFrame:
    """The k nearest donors, by (distance, time), of each receiver and missing column of a tile pair."""
    names = [*keys, ts, "_col", "_dist", "_dts", "_dv"]
    recv = pdf[pdf["_side"] == 0]
    don = pdf[pdf["_side"] == 1].sort_values(ts, kind="stable")
    r, d = recv[cols].to_numpy(dtype="float64"), don[cols].to_numpy(dtype="float64")
    if not len(r) or not len(d):
        return pd.DataFrame(columns=names)
    acc, shared = np.zeros((len(r), len(d))), np.zeros((len(r), len(d)), np.int16)
    for j in range(len(cols)):
        diff = r[:, j][:, None] - d[:, j][None, :]
        diff *= diff
        ok = ~np.isnan(diff)
        acc += np.where(ok, diff, 0.0)
        shared += ok
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = (float(len(cols)) / shared) * acc
    dist[shared == 0] = np.inf
    out = []
    for j, c in enumerate(cols):
        ri, di = np.flatnonzero(np.isnan(r[:, j])), np.flatnonzero(~np.isnan(d[:, j]))
        if not len(ri) or not len(di):
            continue
        sub = dist[np.ix_(ri, di)]
        kth = np.partition(sub, k - 1, axis=1)[:, k - 1:k] if len(di) > k else np.full((len(ri), 1), np.inf)
        row, at = np.nonzero((sub <= kth) & np.isfinite(sub))  # donors are in order of time
        order = np.lexsort((at, sub[row, at], row))
        row, at = row[order], at[order]
        first = np.searchsorted(row, row)  # where each receiver's donors begin
        near = np.arange(len(row)) - first < k
        row, at = row[near], at[near]
        part = recv.iloc[ri[row]][[*keys, ts]].reset_index(drop=True)
        part["_col"], part["_dist"] = c, sub[row, at]
        part["_dts"], part["_dv"] = don[ts].to_numpy()[di[at]], d[di[at], j]
        out.append(part)
    return pd.concat(out)[names] if out else pd.DataFrame(columns=names)


def knn_impute(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], k: int = 5,
               receiver_tile: int = RECEIVER_TILE, donor_tile: int = DONOR_TILE) -> DataFrame:
    """Fill nulls in ``cols``; rows are identified by (keys, ts)."""
    keys, cols = list(keys), list(cols)
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    any_val = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])
    base = df.select(*keys, ts, *[F.col(c).cast("double").alias(c) for c in cols])
    base = staged_table(base.withColumns({"_recv": any_null, "_don": any_val}), "knn-rows")
    # one row per key: its tiles, and the column means
    stats = base.groupBy(*keys).agg(
        F.ceil(F.sum(F.col("_recv").cast("long")) / F.lit(receiver_tile)).alias("_rt"),
        F.ceil(F.sum(F.col("_don").cast("long")) / F.lit(donor_tile)).alias("_dt"),
        *[exact_mean(F.col(c)).alias(f"_mean_{c}") for c in cols])
    stats = broadcast_if_small(stats)
    sized = base.join(stats.select(*keys, "_rt", "_dt"), keys).filter((F.col("_rt") > 0) & (F.col("_dt") > 0))
    own = lambda n: F.pmod(F.xxhash64(ts, *cols), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    recv = sized.filter("_recv").withColumn("_r", own("_rt")).withColumn("_d", every("_dt")).withColumn("_side", F.lit(0))
    don = sized.filter("_don").withColumn("_d", own("_dt")).withColumn("_r", every("_rt")).withColumn("_side", F.lit(1))
    names = [*keys, ts, *cols, "_r", "_d", "_side"]
    schema = T.StructType([*[base.schema[x] for x in keys], base.schema[ts],
                           T.StructField("_col", T.StringType()), T.StructField("_dist", T.DoubleType()),
                           T.StructField("_dts", base.schema[ts].dataType), T.StructField("_dv", T.DoubleType())])
    part = (recv.select(*names).unionByName(don.select(*names)).groupBy(*keys, "_r", "_d")
            .applyInPandas(lambda pdf: _tile_topk(pdf, keys, ts, cols, k), schema))
    rk = [*keys, ts, "_col"]
    w = Window.partitionBy(*rk).orderBy("_dist", "_dts")
    top = part.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    agg = top.groupBy(*rk).agg(*[F.max(F.when(F.col("_rank") == i, F.col("_dv"))).alias(f"_v{i}")
                                  for i in range(1, k + 1)], F.count(F.lit(1)).alias("_nv"))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_v{i}"), F.lit(0.0)) for i in range(1, k + 1)])
    agg = agg.select(*keys, ts, "_col", (total / F.col("_nv")).alias("_imp"))
    wide = agg.groupBy(*keys, ts).agg(*[F.max(F.when(F.col("_col") == c, F.col("_imp"))).alias(f"_knn_{c}")
                                          for c in cols])
    j = df.join(wide, [*keys, ts], "left").join(stats.drop("_rt", "_dt"), keys, "left")
    j = j.withColumns({c: F.when(F.col(c).isNull(), F.coalesce(F.col(f"_knn_{c}"), F.col(f"_mean_{c}")))
                        .otherwise(F.col(c)) for c in cols})
    return j.drop(*[f"_knn_{c}" for c in cols], *[f"_mean_{c}" for c in cols])
