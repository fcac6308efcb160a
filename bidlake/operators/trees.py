"""Tree-ensemble scoring over feature arrays, a batch at a time."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A node is (feature, threshold, left, right, leaf value); feature -1 marks a leaf.
Tree = list[tuple[int, float, int, int, float]]


def sample_forest(trees: int = 20, depth: int = 4, features: int = 64, seed: int = 7) -> list[Tree]:
    """A forest made by a rule, as no trained one is at hand."""
    r = random.Random(seed)

    def grow(tree: Tree, left: int) -> int:
        at = len(tree)
        tree.append((-1, 0.0, -1, -1, r.uniform(-1, 1)))
        if left:
            feature, threshold = r.randrange(features), r.uniform(-0.2, 0.2)
            a, b = grow(tree, left - 1), grow(tree, left - 1)
            tree[at] = (feature, threshold, a, b, 0.0)
        return at

    out: list[Tree] = []
    for _ in range(trees):
        out.append([])
        grow(out[-1], depth)
    return out


def walk(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf values of the rows of x: left if the value is at most the threshold or missing."""
    feature, threshold, left, right, leaf = (np.array(c) for c in zip(*tree, strict=True))
    at = np.zeros(len(x), np.int64)
    while (inner := feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        v = x[rows, feature[at[rows]]]
        at[rows] = np.where(np.isnan(v) | (v <= threshold[at[rows]]), left[at[rows]], right[at[rows]])
    return leaf[at]


def tree_scores(features: Column, forest: list[Tree]) -> Column:
    width = 1 + max(n[0] for t in forest for n in t)

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        x = np.zeros((len(rows), width))
        for i, row in enumerate(rows):
            if row is not None:
                x[i, : min(width, len(row))] = row[:width]
        return pd.Series(sum(walk(t, x) for t in forest), dtype="float64")

    return score(features)
