"""Shapley attributions and interactions of boosted trees, by the trees' own cover of their training rows.

In the game of a tree, at a split on a known feature a row goes its way, at another both ways count by their shares of the
training rows. The game is a sum over leaves of products over the features on the leaf's path: a known feature gives 1 or 0,
whether the row keeps to the path at its splits, an unknown one the product of the path's shares there. The Shapley value of
such a product is (own 1 or 0, less own share) times the integral over t in (0, 1) of the product, over the path's other
features, of share (1 - t) + (1 or 0) t, as the weights of the subsets are the integrals of t^s (1 - t)^(d - 1 - s). The
integrand is a polynomial, so that a Gauss rule of half its degree is exact: the work grows with the square of the depth, not
with the number of subsets. Interactions leave two features out of the product. The attributions are summed over
the trees; with the base they add up to the margin. The trees are small and go to the tasks; rows are attributed in Arrow batches
where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame

from tidewell.operators.models import COUNT, counted
from tidewell.shipping import ship

#: (feature, threshold, left, right, value, rows), feature -1 for a leaf; children by their places.
Node = tuple[int, float, int, int, float, float]


def exported(model: PipelineModel) -> list[tuple[float, list[Node]]]:
    """(weight, nodes) of each tree of the model's last stage, thresholds as values of the features where the trees have buckets of them."""
    trees, split = model.stages[-1], [s for s in model.stages if isinstance(s, Bucketizer)]
    edges = split[0].getSplitsArray() if split else None

    def of_values(n: Node) -> Node:
        # buckets up to the threshold's have the values below the edge that follows it
        return n if edges is None or n[0] < 0 else (n[0], float(np.nextafter(edges[n[0]][int(np.floor(n[1])) + 1], -np.inf)), *n[2:])

    return [(float(w), [of_values(n) for n in _nodes(t._java_obj.rootNode())]) for w, t in zip(trees.treeWeights, trees.trees, strict=True)]


def _nodes(root) -> list[Node]:
    nodes: list[Node] = []

    def visit(node) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, float(node.prediction()), float(node.impurityStats().count())))
        if node.subtreeDepth() > 0:
            split = node.split()
            left, right = visit(node.leftChild()), visit(node.rightChild())
            nodes[at] = (int(split.featureIndex()), float(split.threshold()), left, right, *nodes[at][4:])
        return at

    visit(root)
    return nodes


#: A leaf's value, and for each feature of its path the product of its shares and the bounds (low, high] that a row has to keep to.
Leaf = tuple[float, list[tuple[int, float, float, float]]]


def leaves(nodes: list[Node]) -> list[Leaf]:
    found: list[Leaf] = []

    def visit(at: int, path: dict[int, tuple[float, float, float]]) -> None:
        feature, threshold, left, right, value, _ = nodes[at]
        if feature < 0:
            found.append((value, [(f, *p) for f, p in sorted(path.items())]))
            return
        share, low, high = path.get(feature, (1.0, -np.inf, np.inf))
        whole = nodes[left][5] + nodes[right][5]
        visit(left, path | {feature: (share * nodes[left][5] / whole, low, min(high, threshold))})
        visit(right, path | {feature: (share * nodes[right][5] / whole, max(low, threshold), high)})

    visit(0, {})
    return found


def _products(leaf: Leaf, x: np.ndarray, left_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(steps, factors, product, weights): how much each feature of the path changes the product, and its terms at the nodes of the rule.

    A row that lacks a value goes to the right, as in the tree. Factors are above zero inside (0, 1), so that any of them can
    be divided out of the product.
    """
    path = leaf[1]
    keeps = np.array([(x[:, f] <= high if high < np.inf else True) & ~(x[:, f] <= low) for f, _, low, high in path], dtype=float).reshape(len(path), len(x))
    share = np.array([s for _, s, *_ in path])[:, None]
    t, weights = np.polynomial.legendre.leggauss(max(1, (len(path) - left_out) // 2 + 1))
    t = ((t + 1) / 2)[:, None, None]
    factors = share * (1 - t) + keeps * t
    return keeps - share, factors, factors.prod(axis=1), weights / 2


def shapley(trees: list[tuple[float, list[Node]]], x: np.ndarray) -> tuple[float, np.ndarray]:
    """(base, attributions rows x features) of the margin."""
    base, phi = 0.0, np.zeros(x.shape)
    for weight, nodes in trees:
        for leaf in leaves(nodes):
            value, path = weight * leaf[0], leaf[1]
            base += value * float(np.prod([s for _, s, *_ in path]))
            if not path or not len(x):
                continue
            steps, factors, product, weights = _products(leaf, x, 1)
            for i, (f, *_) in enumerate(path):
                phi[:, f] += value * steps[i] * (weights @ (product / factors[:, i]))
    return base, phi


def interactions(trees: list[tuple[float, list[Node]]], x: np.ndarray) -> np.ndarray:
    """rows x features x features: the Shapley interaction index, halved between both orders.

    The diagonal is what is left of the attribution, so that each row of a row's matrix adds up to it.
    """
    n, m = x.shape
    pairs = np.zeros((n, m, m))
    for weight, nodes in trees:
        for leaf in leaves(nodes) if n else []:
            path = leaf[1]
            if len(path) < 2:
                continue
            steps, factors, product, weights = _products(leaf, x, 2)
            for i, j in combinations(range(len(path)), 2):
                both = weight * leaf[0] / 2 * steps[i] * steps[j] * (weights @ (product / (factors[:, i] * factors[:, j])))
                pairs[:, path[i][0], path[j][0]] += both
                pairs[:, path[j][0], path[i][0]] += both
    at = np.arange(m)
    pairs[:, at, at] = shapley(trees, x)[1] - pairs.sum(axis=2)
    return pairs


def by_cell(trees: list[tuple[float, list[Node]]], of: Callable[[np.ndarray], np.ndarray], features: int, most: int = 1 << 16) -> Callable[[np.ndarray], np.ndarray]:
    """of, worked out once for each cell between the trees' thresholds: rows of one cell go the same ways, and have the same values.

    Thresholds are few (a bin's each), so that most cells have been met after some batches; those of more than `most` are forgotten.
    A missing value goes to the right everywhere, as one above all thresholds does.
    """
    edges = [np.unique([n[1] for _, nodes in trees for n in nodes if n[0] == f]) for f in range(features)]
    known: dict[str, np.ndarray] = {}

    def look_up(x: np.ndarray) -> np.ndarray:
        code = np.zeros(len(x), dtype=np.int64)
        for f, e in enumerate(edges):
            code = code * (len(e) + 1) + np.searchsorted(e, x[:, f])
        cells, first, back = np.unique(code, return_index=True, return_inverse=True)
        old = known.get("cells", np.zeros(0, dtype=np.int64))
        new = ~np.isin(cells, old, assume_unique=True)
        if new.any() or not len(x):
            values = of(x[first[new]])
            if len(old) and len(old) + len(values) <= most:
                old, values = np.concatenate([old, cells[new]]), np.concatenate([known["values"], values])
            elif len(old):
                old, values = cells, of(x[first])
            else:
                old = cells[new]
            order = np.argsort(old)
            known["cells"], known["values"] = old[order], values[order]
        return known["values"][np.searchsorted(known["cells"], cells)][back]

    if np.prod([float(len(e) + 1) for e in edges]) >= 2.0**62:
        return of
    return look_up


def attributed(model: PipelineModel, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """keys, feature, value, attribution: a row for each row and feature. rows has the features that the last stage was fitted with, in `features`."""
    trees = exported(model)
    kind = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kind[k]}" for k in keys) + ", feature string, value double, attribution double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phi_of = by_cell(trees, lambda x: shapley(trees, x)[1], len(features))
        for b in batches:
            x = np.column_stack([b[f].to_numpy(zero_copy_only=False).astype(float) for f in features])
            phi = phi_of(x)
            for i, f in enumerate(features):
                columns = [b[k] for k in keys] + [pa.repeat(f, len(b)), b[f].cast(pa.float64()), pa.array(phi[:, i])]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "feature", "value", "attribution"])

    ship(rows.sparkSession)
    return rows.select(*keys, *features).mapInArrow(work, schema)


def partners(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """a, b, strength, n: sums of the absolute interactions of each two features over a task's rows (see models.COUNT); to be summed up."""
    trees = exported(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs_of = by_cell(trees, lambda x: np.abs(interactions(trees, x)), len(features))
        total, n = np.zeros((len(features), len(features))), 0
        for b in batches:
            many = b[COUNT].to_numpy()
            total += np.tensordot(many.astype(float), pairs_of(b[features].to_numpy(dtype=float)), axes=1)
            n += int(many.sum())
        yield pd.DataFrame([(a, c, 2 * total[i, j], n) for i, a in enumerate(features) for j, c in enumerate(features) if i < j], columns=["a", "b", "strength", "n"])

    ship(rows.sparkSession)
    return rows.select(*features, counted(rows).alias(COUNT)).mapInPandas(work, "a string, b string, strength double, n long")
