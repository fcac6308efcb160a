"""Boosted trees that learn to order lists: gradients of pairs weighted by what swapping them does to the list's gain, trees from histograms.

A firm's candidates are a list. In each round the pairs of a list pull its relevant items up and the others down, the more the worse they stand and
the nearer the top a swap would reach; lists are judged side by side in tasks. A tree is grown level by level: tasks add gradients by node, column
and bin of the column, so the driver sees nodes x columns x bins sums, never rows, and picks each node's best split. Columns are cut into bins by
their quantiles once. A list longer than `longest` is dealt by a hash of its items into lists of its own, so no task holds more of one.

rows has the group's key, the item's key, label (above 0 is relevant, null is not) and the columns. Missing values go left. Lists without a relevant
item or without another teach nothing. Equal scores are ordered by item. Rows that are there twice count twice. Without rows there are no trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, kept
from .trees import Tree, tree_scores

STATE = "list string, item string, label int, b binary, score double"


def gradients(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How strongly each item of a list is pulled up, and how sure that is."""
    g, h = np.zeros(len(score)), np.zeros(len(score))
    up, down = np.flatnonzero(label > 0), np.flatnonzero(label <= 0)
    if not len(up) or not len(down):
        return g, h
    rank = np.empty(len(score), np.int64)
    rank[np.argsort(-score, kind="stable")] = np.arange(len(score))
    discount = 1 / np.log2(2.0 + rank)
    ideal = (1 / np.log2(2.0 + np.arange(len(up)))).sum()
    swap = np.abs(discount[up][:, None] - discount[down]) / ideal
    wrong = 1 / (1 + np.exp(np.clip(score[up][:, None] - score[down], -50, 50)))
    pull, sure = wrong * swap, wrong * (1 - wrong) * swap
    g[up], g[down] = pull.sum(1), -pull.sum(0)
    h[up], h[down] = sure.sum(1), sure.sum(0)
    return g, h


def _at(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node of each row in a tree whose thresholds are bins."""
    at = np.zeros(len(bins), np.int64)
    feature, limit, left, right = (np.array(c) for c in list(zip(*tree, strict=True))[:4])
    while (inner := feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        at[rows] = np.where(bins[rows, feature[at[rows]]] <= limit[at[rows]], left[at[rows]], right[at[rows]])
    return at


def _binned(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, len(edges))
            bins = np.stack([np.where(np.isnan(x[:, k]), 0, np.searchsorted(e, x[:, k], "left") + 1) for k, e in enumerate(edges)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in bins], pa.binary()), pa.array(np.zeros(batch.num_rows))], names=["list", "item", "label", "b", "score"])

    return run


def _graded(last: Tree | None):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable").reset_index(drop=True)
        score = rows["score"].to_numpy(float)
        if last:
            bins = np.frombuffer(b"".join(rows["b"]), np.uint8).reshape(len(rows), -1)
            score = score + np.array([n[4] for n in last])[_at(last, bins)]
        g, h = gradients(score, rows["label"].to_numpy(float))
        return rows.assign(score=score, g=g, h=h)

    return run


def _histograms(tree: Tree, nodes: list[int], columns: int, bins: int):
    place = {n: k for k, n in enumerate(nodes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(nodes), columns, bins))
        for batch in batches:
            b = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, columns)
            at = _at(tree, b)
            for n in nodes:
                rows = at == n
                for k in range(columns):
                    for s, w in enumerate((batch.column(1).to_numpy()[rows], batch.column(2).to_numpy()[rows], None)):
                        sums[s, place[n], k] += np.bincount(b[rows, k], w, bins)
        n, k, i = np.nonzero(sums[2])
        if len(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int32)[n]), pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), *(pa.array(sums[s, n, k, i]) for s in range(3))], names=["node", "k", "bin", "g", "h", "n"])

    return run


def _split(rows: list, columns: int, bins: int, least: int, calm: float) -> tuple[float, int, int, tuple[float, float], tuple[float, float]] | None:
    """(gain, column, last bin to the left, sums of the left, sums of the right) of a node's best split; the first of equal ones."""
    sums = np.zeros((3, columns, bins))
    for r in rows:
        sums[:, r["k"], r["bin"]] = r["g"], r["h"], r["n"]
    left = sums.cumsum(2)
    whole = left[:, :, -1:]
    right = whole - left
    value = lambda s: s[0] ** 2 / (s[1] + calm)
    gain = np.where((left[2] >= least) & (right[2] >= least), value(left) + value(right) - value(whole), -1.0)
    k, i = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[k, i] <= 1e-12:
        return None
    return float(gain[k, i]), int(k), int(i), (left[0, k, i], left[1, k, i]), (right[0, k, i], right[1, k, i])


def fit(rows: DataFrame, columns: list[str], group: str = "firm_id", item: str = "ocid", trees: int = 50, depth: int = 4, rate: float = 0.1, bins: int = 32, least: int = 20, calm: float = 1.0, longest: int = 1000) -> list[Tree]:
    """Trees over the columns in their order; tree_scores() and scored() walk them."""
    values = [F.col(c).cast("double") for c in columns]
    cuts = rows.agg(*(F.percentile_approx(F.when(~F.isnan(v), v), [k / bins for k in range(1, bins)], 10_000).alias(f"q{k}") for k, v in enumerate(values))).first()
    edges = [np.unique(np.array(cuts[f"q{k}"] or [], float)) for k in range(len(columns))]
    count = rows.groupBy(group).agg(F.ceil(F.count("*") / longest).cast("int").alias("_lists"))
    name = F.concat_ws("|", F.col(group).cast("string"), F.pmod(F.xxhash64(F.col(item)), F.col("_lists")).cast("string"))
    dealt = rows.join(count, group).select(name.alias("list"), F.col(item).cast("string").alias("item"), F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), F.array(*values).alias("x"))
    state, last, out = kept(dealt.mapInArrow(_binned(edges), STATE), "lists"), None, []
    width = bins + 1
    for _ in range(trees):
        graded = kept(state.groupBy("list").applyInPandas(_graded(last), f"{STATE}, g double, h double"), "graded")
        dropped(state)
        tree: Tree = [(-1, 0.0, -1, -1, 0.0)]
        open_nodes = [0]
        for _ in range(depth):
            if not open_nodes:
                break
            sums = graded.select("b", "g", "h").mapInArrow(_histograms(tree, open_nodes, len(columns), width), "node int, k int, bin int, g double, h double, n double")
            found = sums.groupBy("node", "k", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
            grown = []
            for node in open_nodes:
                best = _split([r for r in found if r["node"] == node], len(columns), width, least, calm)
                if best:
                    _, k, i, *sides = best
                    tree[node] = (k, float(i), len(tree), len(tree) + 1, 0.0)
                    grown += [len(tree), len(tree) + 1]
                    tree += [(-1, 0.0, -1, -1, rate * g / (h + calm)) for g, h in sides]
            open_nodes = grown
        if len(tree) == 1:
            dropped(graded)
            break
        last = tree
        out.append([(k, (-np.inf if i < 1 else float(edges[k][min(int(i), len(edges[k])) - 1])) if k >= 0 else 0.0, a, b, v) for k, i, a, b, v in tree])
        state = graded.drop("g", "h")
        state.kept_path = graded.kept_path
    else:
        dropped(state)
    return out


def scored(model: list[Tree], rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with score; without trees all score 0."""
    if not model:
        return rows.withColumn("score", F.lit(0.0))
    return rows.withColumn("score", tree_scores(F.array(*(F.col(c).cast("double") for c in columns)), model))
