"""Forests as tables of nodes: against a plain grower, Spark's forest and the trees themselves."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mailquarry.operators import evaluate, forest, learn, trees
from mailquarry.plans import registry
from mailquarry.plans.staging import scratch

NAMES = [f"v{i}" for i in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(500):
        x = [float(v) for v in rng.normal(0, 1, 4)] + [float(rng.integers(3)), 1.0]
        rows.append((i, int(x[0] + x[4] + rng.normal(0, 0.7) > 1), *x))
    df = spark.createDataFrame(rows, "mail_id long, label int, " + ", ".join(f"{n} double" for n in NAMES))
    return df.withColumn("features", array_to_vector(F.array(*NAMES))).cache()


def _plain_gain(rank, y, w, draws, f, cut, least):
    left = rank[:, f] <= cut
    if min(draws[left].sum(), draws[~left].sum()) < least:
        return 0.0
    gini = lambda m: 0.0 if not (w * draws)[m].sum() else 2 * (w * draws * y)[m].sum() * (1 - (w * draws * y)[m].sum() / (w * draws)[m].sum())
    return gini(left | ~left) - gini(left) - gini(~left)


def test_root_is_the_best_cut_and_leaves_hold_shares():
    rng = np.random.default_rng(0)
    rank, y, w = rng.integers(0, 32, (400, 3)).astype(np.uint8), rng.integers(0, 2, 400).astype(np.uint8), rng.random(400) + 0.5
    y[rank[:, 1] > 20] = 1
    node, feature, cut, left, right, share = forest.grow(rank, y, w, np.random.default_rng(7), 6, 3, 3)
    draws = np.random.default_rng(7).poisson(1.0, 400)
    gains = {(f, c): _plain_gain(rank, y, w, draws, f, c, 3) for f in range(3) for c in range(32)}
    assert np.isclose(gains[feature[0], cut[0]], max(gains.values()))
    place = dict(zip(node, range(len(node)), strict=True))
    at = np.zeros(400, int)
    for _ in range(6):
        at = np.array([a if feature[a] < 0 else place[left[a] if rank[i, feature[a]] <= cut[a] else right[a]] for i, a in enumerate(at)])
    weight = w * draws
    for leaf in np.flatnonzero(feature < 0):
        rows = at == leaf
        assert draws[rows].sum() >= 3 and np.isclose(share[leaf], (weight * y)[rows].sum() / weight[rows].sum())
    for a in np.flatnonzero(feature >= 0):                   # no two sibling leaves of one class
        low, high = place[left[a]], place[right[a]]
        assert feature[low] >= 0 or feature[high] >= 0 or (share[low] > 0.5) != (share[high] > 0.5)


def test_forest_is_a_table_that_scores_like_its_trees(spark, data, monkeypatch):
    """However the rows are dealt, and in one slice as in groups of trees; the driver holds no fitted forest."""
    monkeypatch.setattr(learn, "GroupedForest", None)
    monkeypatch.setattr(trees, "LEAST_NODES", 60)
    weighted = learn.with_class_weight(data)
    model = learn.fitted("rf", weighted.repartition(7), {"n_estimators": 25, "max_depth": 8})
    again = learn.fitted("rf", weighted.coalesce(1), {"n_estimators": 25, "max_depth": 8})
    order = lambda m: m.nodes.orderBy("tree", "node").collect()
    assert order(model) == order(again) and model.nodes.select("tree").distinct().count() == 25
    scores = {r.mail_id: r.prob for r in learn.score(model, data).collect()}
    plain = {r.mail_id: r.prob for r in trees.scored(data, model.nodes, model.link, NAMES).collect()}
    assert len(scores) == 500 and all(abs(scores[k] - plain[k]) < 1e-12 for k in plain)
    assert trees._groups(model.nodes).select("_group").distinct().count() > 3
    registry.publish_model(model, NAMES, root := scratch(spark), "m")
    table, record = registry.load(spark, root, "m")
    monkeypatch.setattr(trees, "SLICE_NODES", 50)
    got = {r.mail_id: r.prob for r in registry.scored(data, table, record).collect()}
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-12 for k in plain)


def test_forest_is_as_good_as_sparks(data):
    train, test = (learn.with_class_weight(data.where(c)) for c in ("mail_id % 3 > 0", "mail_id % 3 = 0"))
    made = [learn.score(m, test).withColumn("model", F.lit("rf")) for m in (learn.fitted("rf", train, {"n_estimators": 60}), learn.build("rf", {"n_estimators": 60}).fit(train))]
    ours, sparks = (evaluate.auc(m).first()["auc_roc"] for m in made)
    assert ours > 0.85 and abs(ours - sparks) < 0.03


def test_rows_with_equal_or_missing_ids_are_all_scored(spark, data):
    model = learn.fitted("rf", learn.with_class_weight(data), {"n_estimators": 12, "max_depth": 4})
    twice = data.limit(40).select(F.lit(None).cast("long").alias("mail_id"), "label", "features").unionByName(data.limit(40).select(F.lit(1).cast("long").alias("mail_id"), "label", "features"))
    assert learn.score(model, twice).count() == 80
    assert learn.score(model, twice.where("false")).count() == 0
    one = learn.fitted("rf", learn.with_class_weight(data.where("label = 1")), {"n_estimators": 3})
    assert {r.prob for r in learn.score(one, data).collect()} == {1.0}


def test_all_models_are_trained_and_published_without_sparks_forest(spark, data, monkeypatch):
    """As model_registry does it: folds, the fit on all rows, the published tables."""
    monkeypatch.setattr(learn, "GroupedForest", None)
    models, scores, best = learn.train_all(data, ["rf"], {"rf": {"n_estimators": 12}}, k=2)
    assert best == "rf" and scores["rf"]["cv_f1_mean"] > 0.6 and isinstance(models["rf"], forest.Forest)
    registry.publish_model(models["rf"], NAMES, root := scratch(spark), "rf", {"model": "rf"})
    table, record = registry.load(spark, root, "rf")
    both = registry.scored(data, table, record).join(learn.score(models["rf"], data).withColumnRenamed("prob", "direct"), "mail_id")
    assert both.count() == 500 and both.where(F.abs(F.col("prob") - F.col("direct")) > 1e-9).isEmpty()
