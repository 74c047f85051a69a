"""Shapley values over the leaf table against the path recursion, and their cost."""

import time

import numpy as np
import pytest

from hazecast.models.importance import contributions, expected_value, leaf_paths, shapley_values, tree_arrays


def recursive(x, tree, phi):
    """Path-dependent TreeSHAP of one row by sets: all coalitions of a leaf's features."""
    from itertools import combinations
    from math import factorial

    def walk(j, path):
        if tree["left"][j] < 0:
            k = len(path)
            for f, (o, z) in path.items():
                others = [path[g] for g in path if g != f]
                weight = 0.0
                for s in range(k):
                    for taken in combinations(range(k - 1), s):
                        product = 1.0
                        for i, (oo, zz) in enumerate(others):
                            product *= oo if i in taken else zz
                        weight += product * factorial(s) * factorial(k - 1 - s) / factorial(k)
                phi[f] += tree["weight"] * tree["value"][j] * (o - z) * weight
            return
        f = tree["feature"][j]
        left = x[f] <= tree["threshold"][j]
        for child, taken in ((tree["left"][j], left), (tree["right"][j], not left)):
            o, z = path.get(f, (1.0, 1.0))
            walk(child, {**path, f: (o * taken, z * tree["cover"][child] / tree["cover"][j])})
    walk(0, {})


def random_tree(rng, depth, n_features):
    t = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}

    def grow(d, cover):
        j = len(t["feature"])
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", rng.normal()), ("cover", cover)):
            t[k].append(v)
        if d and cover > 2 and rng.random() < 0.9:
            a = float(rng.integers(1, int(cover)))
            t["feature"][j], t["threshold"][j] = int(rng.integers(n_features)), float(rng.normal())
            t["left"][j] = grow(d - 1, a)
            t["right"][j] = grow(d - 1, cover - a)
        return j
    grow(depth, 1000.0)
    return {k: np.array(v) for k, v in t.items()} | {"weight": float(rng.random())}


def descend(x, t):
    j = 0
    while t["left"][j] >= 0:
        j = t["left"][j] if x[t["feature"][j]] <= t["threshold"][j] else t["right"][j]
    return t["weight"] * t["value"][j]


@pytest.mark.parametrize("depth,features", [(0, 2), (1, 1), (4, 3), (8, 6), (7, 2)])
def test_equals_the_sum_over_coalitions(depth, features):
    rng = np.random.default_rng(depth)
    trees = [random_tree(rng, depth, features) for _ in range(6)]
    x = rng.normal(size=(12, features))
    x[0, 0], x[1, -1], x[2, 0] = np.nan, np.inf, -np.inf
    x[3, 0] = trees[0]["threshold"][0]  # on a threshold
    got, total = shapley_values(x, leaf_paths(trees))
    for r, row in enumerate(x):
        want = np.zeros(features)
        for t in trees:
            recursive(row, t, want)
        assert np.allclose(got[r], want, rtol=1e-9, atol=1e-9)
        assert abs(total[r] - sum(descend(row, t) for t in trees)) < 1e-9
        assert abs(got[r].sum() + expected_value(trees) - total[r]) < 1e-9


def test_both_tree_models_equal_the_coalitions(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = 3 * x[:, 0] - 2 * x[:, 1] * (x[:, 2] > 0) + rng.normal(scale=0.1, size=300)
    cols = list("abcde")
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, d double, e double, label double")
    va = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    for est in (RandomForestRegressor(numTrees=5, maxDepth=6, seed=1), GBTRegressor(maxIter=5, maxDepth=4, seed=1)):
        m = est.fit(va)
        trees = tree_arrays(m)
        for r in contributions(df.limit(20), m, cols, ["id"]).collect():
            want = np.zeros(5)
            for t in trees:
                recursive(x[r["id"]], t, want)
            assert np.allclose(r["contrib"], want, rtol=1e-9, atol=1e-9)


def test_ten_thousand_rows_of_four_hundred_trees_in_a_minute():
    rng = np.random.default_rng(1)
    trees = [random_tree(rng, 5, 27) for _ in range(400)]
    x = rng.normal(size=(10_000, 27))
    began = time.process_time()
    got, total = shapley_values(x[:2_000], leaf_paths(trees))
    assert (time.process_time() - began) * 5 < 60
    assert np.allclose(got.sum(axis=1) + expected_value(trees), total)


def test_no_rows():
    rng = np.random.default_rng(2)
    got, total = shapley_values(np.zeros((0, 3)), leaf_paths([random_tree(rng, 3, 3)]))
    assert got.shape == (0, 3) and total.shape == (0,)
