"""Random forest for yes/no labels on numeric features: trees are grown in Spark tasks from one bounded sample."""
from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession


def grow(x: np.ndarray, y: np.ndarray, seed: int, depth: int = 10, leaf: int = 3) -> list[tuple[int, float, int, int, float]]:
    """One tree on a bootstrap of the rows: nodes (feature, threshold, left, right, share of ones), leaves with feature
    -1.  Each node looks at a random root of the features and takes the split with the least Gini impurity."""
    rng = np.random.default_rng(seed)
    picked = rng.integers(0, len(y), len(y))
    x, y = x[picked], y[picked].astype(np.float64)
    width = max(1, int(round(x.shape[1] ** 0.5)))
    nodes: list = []

    def build(at: np.ndarray, level: int) -> int:
        me, share = len(nodes), float(y[at].mean())
        nodes.append((-1, 0.0, -1, -1, share))
        if level == depth or len(at) < 2 * leaf or share in (0.0, 1.0):
            return me
        best = (1e9, -1, 0.0)
        for f in rng.choice(x.shape[1], width, replace=False):
            order = np.argsort(x[at, f], kind="stable")
            v, t = x[at, f][order], y[at][order]
            n = np.arange(1, len(at))
            ones = np.cumsum(t)
            l, r = ones[:-1], ones[-1] - ones[:-1]
            m = len(at) - n
            cost = l * (n - l) / n + r * (m - r) / m
            cost[(v[1:] == v[:-1]) | (n < leaf) | (m < leaf)] = 1e9
            if len(cost) and (i := int(np.argmin(cost))) is not None and cost[i] < best[0]:
                best = (float(cost[i]), int(f), float((v[i] + v[i + 1]) / 2))
        if best[1] < 0:
            return me
        go = x[at, best[1]] <= best[2]
        nodes[me] = (best[1], best[2], build(at[go], level + 1), build(at[~go], level + 1), share)
        return me

    build(np.arange(len(y)), 0)
    return nodes


class Forest:
    def __init__(self, trees: list[list]):
        self.trees = [tuple(np.array(c) for c in zip(*t)) for t in trees]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of ones in the leaves that the rows reach; 0 without trees."""
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while len(live := np.flatnonzero(feature[at] >= 0)):
                node = at[live]
                at[live] = np.where(x[live, feature[node]] <= threshold[node], left[node], right[node])
            total += share[at]
        return total / max(1, len(self.trees))


def fit(spark: SparkSession, x: np.ndarray, y: np.ndarray, trees: int = 32) -> Forest:
    """A forest from a bounded sample, a tree a row of a range, so that a lost task only regrows its trees."""
    if not len(y):
        return Forest([])
    shared = spark.sparkContext.broadcast((x, y))

    def plant(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf.id, "tree": [pickle.dumps(grow(*shared.value, seed=int(i))) for i in pdf.id]})

    grown = spark.range(0, trees, 1, min(trees, 8)).mapInPandas(plant, "id long, tree binary").collect()
    return Forest([pickle.loads(r.tree) for r in sorted(grown, key=lambda r: r.id)])
