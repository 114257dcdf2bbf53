"""Fitted tree ensembles as node tables: export, scoring and attribution by ablation.

A node table has one row per node: ``tree, node, feature, threshold, left, right, value``; a leaf has feature -1 and its
share of the score as value. Scores are sums over trees, so an ensemble is read in slices of bounded size, each a pass
over the rows in which a row's sums grow. A row is never exploded: the sums with one feature replaced at a time are an
array in it, and only trees that use a feature are walked again for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.operators import clean
from mailquarry.plans.staging import written

SLICE_NODES = 1 << 20       # nodes of a slice, 32 MB; a larger single tree is a slice of its own
MOST_GROUPS, LEAST_NODES = 48, 1 << 18
MEAN, LOGISTIC = "mean", "logistic"
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"


def exported(model: PipelineModel | RandomForestClassificationModel | GBTClassificationModel, path: str) -> tuple[DataFrame, str]:
    """Node table of a fitted forest or boosted ensemble, saved at ``path``, and how its sums become probabilities."""
    trees = model.stages[-1] if isinstance(model, PipelineModel) else model
    trees.write().overwrite().save(path)
    stored = SparkSession.active().read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    leaf = F.col("leftChild") < 0
    if isinstance(trees, GBTClassificationModel):
        weights = F.array(*[F.lit(float(w)) for w in trees.treeWeights])
        value, link = F.col("prediction") * F.get(weights, F.col("tree")), LOGISTIC
    else:
        total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
        value, link = F.col("impurityStats")[1] / total / len(trees.trees), MEAN
    return stored.select("tree", F.col("id").alias("node"), F.when(leaf, F.lit(-1)).otherwise(F.col("split.featureIndex")).alias("feature"),
                         F.when(~leaf, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
                         F.when(leaf, value).otherwise(F.lit(0.0)).alias("value")), link


@dataclass
class _Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def walk(self, x: np.ndarray, replaced: int = -1, by: float = 0.0) -> np.ndarray:
        """Value of the leaf of every row, with one feature replaced if asked for."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            feature = self.feature[node]
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                return self.value[node]
            own = feature[inner]
            seen = x[rows[inner], own]
            if replaced >= 0:
                seen = np.where(own == replaced, by, seen)
            at = node[inner]
            node[inner] = np.where(seen <= self.threshold[at], self.left[at], self.right[at])


def _slices(nodes: DataFrame) -> Iterator[list[_Tree]]:
    """The trees in slices of about SLICE_NODES nodes, collected one at a time."""
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n")).orderBy("tree").collect()         # a row per tree
    first, n = 0, 0
    for i, r in enumerate(sizes):
        n += r.n
        if n >= SLICE_NODES or i == len(sizes) - 1:
            part = nodes.where(F.col("tree").between(sizes[first].tree, r.tree)).toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
            tree = part.column("tree").to_numpy()
            cut = np.flatnonzero(np.diff(tree)) + 1
            columns = [np.split(np.nan_to_num(part.column(c).to_numpy().astype(t)), cut) for c, t in
                       (("node", np.int64), ("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("value", float))]
            yield [_numbered(*c) for c in zip(*columns, strict=True)]
            first, n = i + 1, 0


def _numbered(node, feature, threshold, left, right, value) -> _Tree:
    """The tree with its nodes numbered from 0 in order; the root has the smallest number."""
    place = lambda child: np.where(feature >= 0, np.searchsorted(node, child), 0)
    return _Tree(feature, threshold, place(left), place(right), value)


def sums(table: DataFrame, nodes: DataFrame, names: Sequence[str], baseline: Sequence[float] | None = None, id_col: str = "mail_id") -> DataFrame:
    """``id, values, sums``: the features of a row, and its sum over all trees; with a baseline also the sum with each feature replaced by it."""
    values = F.array(*[clean.zero_if_not_finite(F.col(n).cast("double")) for n in names])
    out = table.select(F.col(id_col), values.alias("values"), F.array_repeat(F.lit(0.0), 1 + (len(names) if baseline is not None else 0)).alias("sums"))
    for trees in _slices(nodes):
        shared = table.sparkSession.sparkContext.broadcast(trees)          # bounded by SLICE_NODES or one tree

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).copy()
                for tree in shared.value:
                    plain = tree.walk(x)
                    total += plain[:, None]
                    for f in np.unique(tree.feature[tree.feature >= 0]) if baseline is not None else ():
                        total[:, f + 1] += tree.walk(x, f, baseline[f]) - plain
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("values"), lists], [id_col, "values", "sums"])

        out = out.mapInArrow(run, out.schema)
    return out


def probability(total: Column, link: str) -> Column:
    return total if link == MEAN else 1 / (1 + F.exp(-2 * total))


def scored(table: DataFrame, nodes: DataFrame, link: str, names: Sequence[str], id_col: str = "mail_id") -> DataFrame:
    """``id, prob`` of every row."""
    if nodes.count() > SLICE_NODES:
        values = F.array(*[clean.zero_if_not_finite(F.col(n).cast("double")) for n in names])
        return scored_by_groups(table, values, nodes, link, [id_col])
    return sums(table, nodes, names, None, id_col).select(id_col, probability(F.col("sums")[0], link).alias("prob"))


def _groups(nodes: DataFrame) -> DataFrame:
    """``tree, _group``: consecutive trees together, so that a group has about a share of 1 / MOST_GROUPS of the nodes, or LEAST_NODES."""
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n")).orderBy("tree").collect()         # a row per tree
    limit = max(LEAST_NODES, sum(r.n for r in sizes) / MOST_GROUPS)
    group, n, found = 0, 0, []
    for r in sizes:
        if n and n + r.n > limit:
            group, n = group + 1, 0
        n += r.n
        found.append((r.tree, group))
    return nodes.sparkSession.createDataFrame(found, "tree int, _group int")


def scored_by_groups(table: DataFrame, values: Column, nodes: DataFrame, link: str, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and ``prob`` of every row, for ensembles of any size.

    Trees are dealt in groups, and every group gets all rows, each feature as its rank among the ensemble's thresholds. No tree
    passes through the driver, and a task holds one group of trees and one block of rows. A row's sums of all groups are added in one order.
    """
    rows = written(table.select(F.struct(*keep).alias("_keep"), values.alias("_values"), F.monotonically_increasing_id().alias("_row")))
    deal = _groups(nodes)
    count = (deal.agg(F.max("_group").alias("n")).first()["n"] or 0) + 1
    dim = rows.agg(F.max(F.size("_values")).alias("n")).first()["n"] or 0
    cuts = [np.empty(0)] * dim
    for r in nodes.where("feature >= 0").groupBy("feature").agg(F.sort_array(F.collect_set("threshold")).alias("cuts")).collect():       # as many as the fit had bins
        if r.feature < dim:
            cuts[r.feature] = np.array(r.cuts)
    kind = _rank_type(cuts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("_values").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            made = [b.column("_row").to_numpy(), ranked(x, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in made], ["_rows", "_ranks"])

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    blocks = written(rows.select("_row", "_values").mapInArrow(pack, "_rows binary, _ranks binary")).select(
        F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_group"), none(f"struct<{NODES.replace(', ', ',').replace(' ', ':')}>", "_node"), "_rows", "_ranks")
    dealt = (nodes.join(F.broadcast(deal), "tree").select("_group", F.struct(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in NODES.split(", "))]).alias("_node"), none("binary", "_rows"), none("binary", "_ranks"))
             .unionByName(blocks).repartitionByRange(count, "_group").sortWithinPartitions("_group", F.col("_rows").isNotNull(), "_node.tree", "_node.node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, held = None, [], []
        for batch in batches:
            groups, is_row = batch.column("_group").to_numpy(), batch.column("_rows").is_valid().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(groups) | np.diff(is_row)) + 1
            for start, end in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if groups[start] != group:
                    group, parts, held = groups[start], [], []
                if not is_row[start]:
                    parts.append(batch.column("_node").slice(start, end - start))
                    continue
                if parts:
                    held, parts = _ranked_trees(pa.concat_arrays(parts), cuts), []
                for i in range(start, end):
                    ids = np.frombuffer(batch.column("_rows")[i].as_py(), np.int64)
                    ranks = np.frombuffer(batch.column("_ranks")[i].as_py(), kind).reshape(len(ids), -1)
                    total = np.zeros(len(ids))
                    for tree in held:
                        total += tree.walk(ranks)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), group, np.int32)), pa.array(total)], ["_row", "_group", "_sum"])

    if not dim:
        return table.select(*keep, F.lit(None).cast("double").alias("prob")).limit(0)
    found = dealt.mapInArrow(run, "_row bigint, _group int, _sum double")
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("_group", "_sum"))), F.lit(0.0), lambda a, s: a + s["_sum"])
    return (rows.select("_keep", "_row").join(found.groupBy("_row").agg(total.alias("_total")), "_row")
            .select("_keep.*", probability(F.col("_total"), link).alias("prob")))


def _rank_type(cuts: Sequence[np.ndarray]) -> type:
    return np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint32


def ranked(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """How many cuts of its feature are below each value; so a value is at most the cut of rank k if its own rank is."""
    out = np.empty(x.shape, _rank_type(cuts))
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, x[:, i])
    return out


def _ranked_trees(nodes: pa.StructArray, cuts: Sequence[np.ndarray]) -> list[_Tree]:
    """The trees of a group, whose nodes are sorted, with ranks for thresholds."""
    tree, node, feature, threshold, left, right, value = (np.nan_to_num(c.to_numpy(zero_copy_only=False)) for c in nodes.flatten())
    rank = np.zeros(len(tree), np.int64)
    for f in np.unique(feature[feature >= 0]):
        own = feature == f
        rank[own] = np.searchsorted(cuts[f], threshold[own])
    cut = np.flatnonzero(np.diff(tree)) + 1
    columns = [np.split(c, cut) for c in (node.astype(np.int64), feature.astype(np.int64), rank, left.astype(np.int64), right.astype(np.int64), value)]
    return [_numbered(*c) for c in zip(*columns, strict=True)]


def contributions(table: DataFrame, nodes: DataFrame, link: str, names: Sequence[str], baseline: Sequence[float], id_col: str = "mail_id") -> DataFrame:
    """``id, contributions`` as for linear models; a contribution is how much the probability falls when the feature gets its baseline value."""
    both = sums(table, nodes, names, list(baseline), id_col)
    whole = probability(F.col("sums")[0], link)
    made = [F.struct(F.lit(n).alias("feature"), F.col("values")[i].alias("value"), F.round(whole - probability(F.col("sums")[i + 1], link), 12).alias("contribution")) for i, n in enumerate(names)]
    return both.select(id_col, F.array(*made).alias("contributions"))
