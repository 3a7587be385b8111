"""Tree attributions against the game over all subsets of features."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import attribution, models


def expected(nodes, known, x, at=0):
    """Value of the tree for each row of x if only the features `known` are."""
    feature, threshold, left, right, value, _ = nodes[at]
    if feature < 0:
        return np.full(len(x), value)
    a, b = expected(nodes, known, x, left), expected(nodes, known, x, right)
    if feature in known:
        return np.where(x[:, feature] <= threshold, a, b)
    share = nodes[left][5] / (nodes[left][5] + nodes[right][5])
    return share * a + (1 - share) * b


def by_subsets(trees, x):
    n, m = x.shape
    base, phi, pairs = 0.0, np.zeros((n, m)), np.zeros((n, m, m))
    for weight, nodes in trees:
        used = sorted({f for f, *_ in nodes if f >= 0})
        k = len(used)
        value = {frozenset(s): weight * expected(nodes, frozenset(s), x) for r in range(k + 1) for s in combinations(used, r)}
        base += float(value[frozenset()][0])
        for s, v in value.items():
            for i in used:
                if i not in s:
                    phi[:, i] += factorial(len(s)) * factorial(k - len(s) - 1) / factorial(k) * (value[s | {i}] - v)
            for i, j in combinations([f for f in used if f not in s], 2):
                both = factorial(len(s)) * factorial(k - len(s) - 2) / factorial(k - 1) * (value[s | {i, j}] - value[s | {i}] - value[s | {j}] + v) / 2
                pairs[:, i, j] += both
                pairs[:, j, i] += both
    pairs[:, np.arange(m), np.arange(m)] = phi - pairs.sum(axis=2)
    return base, phi, pairs


def grown(r, depth, features, n):
    """A random tree of the given depth whose covers add up; features recur on a path."""
    nodes = []

    def grow(level, rows):
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, float(r.normal()), float(rows)))
        if level < depth and rows > 1 and r.random() < 0.9:
            cut = int(r.integers(1, rows))
            left, right = grow(level + 1, cut), grow(level + 1, rows - cut)
            nodes[at] = (int(r.integers(features)), float(r.normal()), left, right, *nodes[at][4:])
        return at

    grow(0, n)
    return nodes


@pytest.mark.parametrize(("depth", "features"), [(0, 2), (1, 1), (2, 3), (3, 5), (4, 4), (7, 3)])
def test_paths_give_the_values_of_the_subsets(depth, features):
    r = np.random.default_rng(depth)
    trees = [(float(r.normal()), grown(r, depth, features, 500)) for _ in range(4)]
    x = r.normal(size=(60, features))
    x[::7, 0] = np.nan
    base, phi = attribution.shapley(trees, x)
    want = by_subsets(trees, x)
    assert np.isclose(base, want[0]) and np.allclose(phi, want[1], atol=1e-10)
    assert np.allclose(attribution.interactions(trees, x), want[2], atol=1e-10)


def test_deep_trees_of_many_features_add_up():
    r = np.random.default_rng(9)
    trees = [(1.0, grown(r, 8, 15, 100_000)) for _ in range(3)]
    x = r.normal(size=(200, 15))
    base, phi = attribution.shapley(trees, x)
    margin = sum(expected(t, frozenset(range(15)), x) for _, t in trees)
    assert np.allclose(base + phi.sum(axis=1), margin, atol=1e-9)
    assert np.allclose(attribution.interactions(trees, x).sum(axis=2), phi, atol=1e-9)


def test_attributions_of_a_fitted_model(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, c double, label int").repartition(3)
    model = models.boosted(["a", "b", "c"], rounds=4, depth=5).fit(df)
    trees = attribution.exported(model)
    base, phi = attribution.shapley(trees, x)
    margin = sum(w * expected(t, frozenset(range(3)), x) for w, t in trees)
    proba = np.array([q.proba for q in models.predict(model, df).orderBy("i").collect()])
    assert np.allclose(base + phi.sum(axis=1), margin) and np.allclose(1 / (1 + np.exp(-2 * margin)), proba)
    got = {(q.i, q.feature): q.attribution for q in attribution.attributed(model, df, ["a", "b", "c"], ["i"]).collect()}
    assert all(abs(got[i, f] - phi[i, k]) < 1e-9 for i in range(400) for k, f in enumerate("abc"))
    both = attribution.partners(model, df, ["a", "b", "c"]).groupBy("a", "b").agg((F.sum("strength") / F.sum("n")).alias("s")).collect()
    strength = {(q.a, q.b): q.s for q in both}
    assert max(strength, key=strength.get) == ("b", "c")
    assert attribution.attributed(model, df.limit(0), ["a", "b", "c"], ["i"]).count() == 0
    stump = [(2.0, [(1, 0.5, 1, 2, 0.0, 4.0), (-1, 0, -1, -1, 0.0, 3.0), (-1, 0, -1, -1, 2.0, 1.0)])]
    assert attribution.shapley(stump, np.array([[0.0, 1.0, 0.0]]))[1].tolist() == [[0.0, 3.0, 0.0]]
