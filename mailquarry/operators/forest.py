"""Random forests that are grown in tasks and stay tables of nodes.

The driver never holds a tree: a deep forest has nearly as many nodes per tree as rows, so its size is that of the table times
the number of trees. Features become ranks among at most ``BINS - 1`` cuts, one byte each; every task gets the ranks of all rows,
draws its own trees' bootstraps and grows them level by level. Rules are those of Spark's forest: Poisson draws, Gini
impurity of weighted classes, a sample of features per node, at least ``least`` drawn rows on either side, and sibling leaves of one
class merged. Draws depend on seed, tree and rows, not on how the rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.operators import trees as T
from mailquarry.plans.staging import written

BINS = 32                   # as in Spark's forest
TREES_OF_TASK = 10          # fixed, so that the number of tasks depends on the forest only
NODES_AT_ONCE = 1024        # whose counts are held together


@dataclass
class Forest:
    """Node table of a fitted forest, of the columns ``trees.NODES``."""
    nodes: DataFrame
    link: str = T.MEAN

    def score(self, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
        """The columns ``keep`` and ``prob``, the probability of class 1, per row."""
        return T.scored_by_groups(df, vector_to_array(features), self.nodes, self.link, keep)


def _cuts(rows: DataFrame, dim: int) -> list[np.ndarray]:
    """Ascending cuts of every feature, its quantiles; a row is left of a cut that is not less than its value."""
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = rows.agg(*[F.percentile_approx(F.get("values", F.lit(i)), shares, F.lit(10_000)).alias(f"q{i}") for i in range(dim)]).first()
    return [np.unique(np.array(q or [], float)) for q in found]


def _blocks(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """One row per batch: sort keys, classes, weights and ranks of its rows as bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("values").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            made = [b.column("key").to_numpy(), b.column("y").to_numpy(zero_copy_only=False).astype(np.uint8), b.column("w").to_numpy(zero_copy_only=False), T.ranked(x, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in made], ["key", "y", "w", "ranks"])

    return rows.mapInArrow(pack, "key binary, y binary, w binary, ranks binary")


def _best(ranks, y, weight, draws, node, chosen, least: int) -> tuple[np.ndarray, ...]:
    """Gain, feature and rank of the best cut of every node; ``chosen`` has the features that a node may use, ``node`` is sorted."""
    n, cells = len(chosen), len(chosen) * BINS
    gain, feature, rank = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for f in chosen.T:
        cell = node * BINS + ranks[np.arange(len(node)), f[node]]
        count = np.bincount(cell, draws, cells).reshape(n, BINS).cumsum(axis=1)
        one, all_ = (np.bincount(cell, w, cells).reshape(n, BINS).cumsum(axis=1) for w in (weight * y, weight))
        # The weighted impurity 2 p (1 - p) of a side is 2 (one - one^2 / all); the gain is a difference of such terms.
        square = lambda a, b: np.divide(a * a, b, out=np.zeros_like(a), where=b > 0)
        whole, whole_one = all_[:, -1:], one[:, -1:]
        better = square(one, all_) + square(whole_one - one, whole - all_) - square(whole_one, whole)
        better[(count < least) | (count[:, -1:] - count < least) | (better < 1e-12 * whole)] = 0
        at = better.argmax(axis=1)
        value = better[np.arange(n), at]
        more = value > gain
        gain[more], feature[more], rank[more] = value[more], f[more], at[more]
    return gain, feature, rank


def grow(ranks: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, depth: int, least: int, features: int) -> list[np.ndarray]:
    """One tree, level by level: ``node, feature, rank, left, right, share``, a leaf with feature -1 and its share of class 1."""
    draws = rng.poisson(1.0, len(y))
    rows = np.flatnonzero(draws)
    node = np.zeros(len(rows), np.int64)           # place of a row's node in its level; rows are sorted by it
    first, n, levels = 0, 1, []
    for level in range(depth + 1):
        used = draws[rows].astype(float)
        weight = w[rows] * used
        one, whole = np.bincount(node, weight * y[rows], n), np.bincount(node, weight, n)
        feature, rank, gain = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
        if level < depth:
            chosen = np.argpartition(rng.random((n, ranks.shape[1]), np.float32), features - 1, axis=1)[:, :features] if features < ranks.shape[1] else np.tile(np.arange(features), (n, 1))
            for start in range(0, n, NODES_AT_ONCE):
                part = slice(start, start + NODES_AT_ONCE)
                own = slice(*np.searchsorted(node, [start, start + NODES_AT_ONCE]))
                gain[part], feature[part], rank[part] = _best(ranks[rows[own]] if n > 1 else ranks[rows], y[rows[own]], weight[own], used[own], node[own] - start, chosen[part], least)
        split = gain > 0
        feature[~split] = -1
        child = np.cumsum(split) * 2 - 2                # place of the left child in the next level
        levels.append({"node": first + np.arange(n), "feature": feature, "rank": rank, "left": np.where(split, first + n + child, -1), "right": np.where(split, first + n + child + 1, -1),
                       "share": np.divide(one, whole, out=np.zeros(n), where=whole > 0)})
        go = split[node]
        rows, node = rows[go], node[go]
        node = child[node] + (ranks[rows, feature[node]] > rank[node])
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        first, n = first + n, 2 * int(split.sum())
        if not n:
            break
    return _merged({k: np.concatenate([lv[k] for lv in levels]) for k in levels[0]}, [len(lv["node"]) for lv in levels])


def _merged(tree: dict[str, np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """The tree without sibling leaves of one class; what is below a merged node is left out."""
    feature, left, right, share = tree["feature"], tree["left"], tree["right"], tree["share"]
    ends = np.cumsum(sizes)
    for end, size in zip(ends[::-1], sizes[::-1], strict=True):
        at = np.arange(end - size, end)
        at = at[feature[at] >= 0]
        low, high = left[at], right[at]
        alike = (feature[low] < 0) & (feature[high] < 0) & ((share[low] > 0.5) == (share[high] > 0.5))
        feature[at[alike]] = -1
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for end, size in zip(ends, sizes, strict=True):
        at = np.arange(end - size, end)
        at = at[kept[at] & (feature[at] >= 0)]
        kept[left[at]] = kept[right[at]] = True
    leaf = feature < 0
    left[leaf] = right[leaf] = -1
    return [tree[k][kept] for k in ("node", "feature", "rank", "left", "right", "share")]


def fit(df: DataFrame, trees: int = 300, depth: int = 20, least: int = 2, max_features: str = "sqrt", seed: int = 42,
        features: str = "features", label: str = "label", weight: str = "weight") -> Forest:
    """A forest over a vector column and a label of 0 and 1; the other columns, such as an id, only tell equal rows apart."""
    if max_features not in ("sqrt", "log2", "all"):
        raise ValueError(f"unknown share of features: {max_features}")
    values = vector_to_array(features)
    others = [c for c in df.columns if c not in (features, label, weight)]
    rows = written(df.select(values.alias("values"), (F.col(label) == 1).alias("y"), F.col(weight).cast("double").alias("w"),
                             F.xxhash64(*[F.col(c) for c in sorted(others)], values, label).alias("key")))
    dim = rows.agg(F.max(F.size("values")).alias("n")).first()["n"]
    if not dim:
        raise ValueError("a forest needs rows with features")
    cuts = _cuts(rows, dim)
    used = {"sqrt": math.ceil(math.sqrt(dim)), "log2": max(1, math.ceil(math.log2(dim))), "all": dim}[max_features]
    groups = math.ceil(trees / TREES_OF_TASK)
    dealt = (written(_blocks(rows, cuts)).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), "*")
             .repartitionByRange(groups, "_group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(row[0], []).append(row[1:])
        data, order = None, None
        for group in sorted(held):
            if data is None:                           # each group has all rows
                data = [np.frombuffer(b"".join(r[i] for r in held[group]), kind) for i, kind in enumerate((np.int64, np.uint8, float, np.uint8))]
                order = np.argsort(data[0], kind="stable")
                y, w, ranks = data[1][order], data[2][order], data[3].reshape(len(order), -1)[order]
            held[group] = []
            for t in range(group * TREES_OF_TASK, min((group + 1) * TREES_OF_TASK, trees)):
                node, feature, rank, left, right, share = grow(ranks, y, w, np.random.default_rng([seed, t]), depth, least, used)
                threshold = np.full(len(node), np.nan)
                for f in np.unique(feature[feature >= 0]):
                    own = feature == f
                    threshold[own] = cuts[f][rank[own]]
                leaf = feature < 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), t, np.int32)), *(pa.array(c.astype(np.int32)) for c in (node, feature)), pa.array(threshold, mask=leaf),
                                                  *(pa.array(c.astype(np.int32)) for c in (left, right)), pa.array(np.where(leaf, share / trees, 0.0))],
                                                 ["tree", "node", "feature", "threshold", "left", "right", "value"])

    return Forest(written(dealt.mapInArrow(run, T.NODES)))
