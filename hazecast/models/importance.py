"""Tree-model feature contributions: path-dependent TreeSHAP (Lundberg et al., 2018).

The trees of a fitted Spark random forest / GBT are read from the model's own
saved node table (``data``: node id, prediction, children, split, weighted
count), turned into a table of leaf paths (bounded by model size, not data) and
shipped to the executors with a broadcast.  Rows to explain are scored in
``mapInPandas``, whole batches at a time over rows x leaves; every output row
carries one contribution per feature, and contributions + expected value =
model prediction.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def tree_arrays(model) -> list[dict]:
    """Flat per-tree arrays (feature, threshold, left, right, value, cover) and tree weights."""
    spark = model.sparkSession if hasattr(model, "sparkSession") else None
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    path = scratch_path(spark, "tree-model")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.impurityStats")[0].alias("cover"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.split.featureIndex").alias("feature"),
        F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold")).toPandas()
    weights = list(model.treeWeights)
    if type(model).__name__.startswith("RandomForest"):
        weights = [1.0 / len(weights)] * len(weights)
    trees = []
    for tid, g in nodes.groupby("treeID"):
        g = g.sort_values("id")
        n = int(g["id"].max()) + 1
        arr = {k: np.zeros(n, dtype="float64") for k in ("value", "cover", "threshold")}
        arr.update({k: np.full(n, -1, dtype="int64") for k in ("left", "right", "feature")})
        idx = g["id"].to_numpy()
        for k in ("value", "cover"):
            arr[k][idx] = g[k].to_numpy()
        arr["threshold"][idx] = g["threshold"].fillna(0.0).to_numpy()
        for k in ("left", "right", "feature"):
            arr[k][idx] = g[k].to_numpy()
        arr["weight"] = float(weights[int(tid)])
        trees.append(arr)
    return trees


@dataclass
class LeafPaths:
    """Leaves whose paths test ``k`` different features, a row per leaf: the features, the interval
    (low, high] that a value must lie in to take the path, the share of the training rows that the
    feature's tests let through, and the leaf's weighted value."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def leaf_paths(trees: Sequence[dict]) -> list[LeafPaths]:
    """The leaves of all trees, grouped by the number of features on their paths."""
    by_size: dict[int, list] = {}
    for t in trees:
        todo = [(0, {})]
        while todo:
            j, path = todo.pop()
            if t["left"][j] < 0:
                by_size.setdefault(len(path), []).append((list(path), list(path.values()), t["weight"] * t["value"][j]))
                continue
            f, at = int(t["feature"][j]), t["threshold"][j]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, span in ((t["left"][j], (low, min(high, at))), (t["right"][j], (max(low, at), high))):
                todo.append((child, {**path, f: (*span, share * t["cover"][child] / t["cover"][j])}))
    out = []
    for k, rows in sorted(by_size.items()):
        spans = np.array([r[1] for r in rows], "float64").reshape(len(rows), k, 3)
        out.append(LeafPaths(np.array([r[0] for r in rows], "int64").reshape(len(rows), k), spans[:, :, 0], spans[:, :, 1],
                             np.maximum(spans[:, :, 2], np.finfo("float64").tiny), np.array([r[2] for r in rows], "float64")))
    return out


#: leaves, and rows times leaves, that are taken at once: what fits a core's cache
LEAVES, CELLS = 2_048, 1 << 16


def shapley_values(x: np.ndarray, paths: Sequence[LeafPaths]) -> tuple[np.ndarray, np.ndarray]:
    """Path-dependent SHAP values (rows x features) and the ensemble's predictions.

    A leaf's value is shared among the features of its path as in the game whose coalitions take the
    path where the row does (o = 1, else 0) and are let through by their share z elsewhere.  The
    Shapley weight of a coalition of s of the k - 1 others is the integral of t^s (1 - t)^(k - 1 - s), so a
    feature's value is (o - z) times the integral of the others' product of z (1 - t) + o t: a polynomial
    of degree k - 1, which ceil(k / 2) Gauss nodes integrate exactly.
    """
    phi, total = np.zeros(x.shape), np.zeros(len(x))
    for p in paths:
        leaves, k = p.feature.shape
        if not k:  # a tree of one leaf
            total += p.value.sum()
            continue
        nodes, weights = np.polynomial.legendre.leggauss((k + 1) // 2)
        nodes, weights = (nodes + 1) / 2, weights / 2
        for first in range(0, leaves, LEAVES):
            part = slice(first, first + LEAVES)
            feature, value = p.feature[part], p.value[part, None]
            low, high, share = (c[part].T[:, :, None] for c in (p.low, p.high, p.share))
            order = np.argsort(feature, axis=0, kind="stable").T
            begins = [np.unique(feature[o, j], return_index=True) for j, o in enumerate(order)]
            step = max(1, CELLS // len(value))
            for at in range(0, len(x), step):
                rows = np.ascontiguousarray(x[at:at + step].T)
                takes = []
                for j in range(k):
                    v = rows[feature[:, j]]
                    # NaN is not below any threshold: it takes every right branch.
                    takes.append((((v <= high[j]) | np.isposinf(high[j])) & (~(v <= low[j]) | np.isneginf(low[j]))).astype("float64"))
                sums = [np.zeros(takes[0].shape) for _ in range(k)]
                for t, w in zip(nodes, weights):
                    factors = [takes[j] * t + share[j] * (1 - t) for j in range(k)]
                    product = factors[0] * w
                    for f in factors[1:]:
                        product *= f
                    for j in range(k):
                        sums[j] += product / factors[j]
                for j in range(k):
                    sums[j] *= (takes[j] - share[j]) * value
                    of, begin = begins[j]
                    phi[at:at + step, of] += np.add.reduceat(sums[j][order[j]], begin, axis=0).T
                for j in range(1, k):
                    takes[0] *= takes[j]
                total[at:at + step] += (takes[0] * value).sum(axis=0)
    return phi, total


def expected_value(trees: list[dict]) -> float:
    total = 0.0
    for t in trees:
        leaf = t["left"] < 0
        total += t["weight"] * float(np.sum(t["value"][leaf] * t["cover"][leaf]) / t["cover"][0])
    return total


def contributions(df: DataFrame, model, feature_cols: Sequence[str], id_cols: Sequence[str] = ()) -> DataFrame:
    """Per row: ``contrib`` (array, one per feature), ``base`` and ``prediction`` of the tree ensemble."""
    cols = list(feature_cols)
    trees = tree_arrays(model)
    base = expected_value(trees)
    bc = df.sparkSession.sparkContext.broadcast(leaf_paths(trees))
    schema = T.StructType([*[df.schema[c] for c in id_cols],
                           T.StructField("contrib", T.ArrayType(T.DoubleType())),
                           T.StructField("base", T.DoubleType()), T.StructField("tree_sum", T.DoubleType())])

    def fn(batches):
        paths = bc.value
        for pdf in batches:
            phi, total = shapley_values(pdf[cols].to_numpy(dtype="float64"), paths)
            res = pdf[list(id_cols)].copy() if id_cols else pd.DataFrame(index=range(len(phi)))
            res["contrib"] = list(phi)
            res["base"] = base
            res["tree_sum"] = total
            yield res
    # per-row work is bounded by model size, not data: spread the rows over all cores
    parts = df.sparkSession.sparkContext.defaultParallelism
    return df.select(*id_cols, *cols).repartition(parts).mapInPandas(fn, schema)
