"""Exported ensembles against the fitted ones, attribution against scoring again, and published versions."""

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mailquarry.operators import attribute, learn, trees
from mailquarry.plans import registry
from mailquarry.plans.staging import scratch

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        x = [rnd.gauss(0, 1), rnd.choice([0.0, 1.0, 2.0]), rnd.random(), 1.0]
        rows.append((i, int(x[0] + x[1] + rnd.gauss(0, 0.7) > 1), *x))
    return spark.createDataFrame(rows, "mail_id long, label int, a double, b double, c double, d double").withColumn("features", array_to_vector(F.array(*NAMES)))


@pytest.fixture(scope="module", params=["rf", "gbt"])
def fitted(request, table):
    estimator = RandomForestClassifier(numTrees=7, maxDepth=5, seed=3) if request.param == "rf" else GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.3, seed=3)
    return estimator.fit(table)


def probabilities(model, table):
    return {r.mail_id: r.p for r in model.transform(table).select("mail_id", F.udf(lambda v: float(v[1]), "double")("probability").alias("p")).collect()}


def test_exported_ensemble_scores_like_the_model(spark, table, fitted, monkeypatch):
    nodes, link = trees.exported(fitted, scratch(spark))
    want = probabilities(fitted, table)
    for limit in (trees.SLICE_NODES, 20):                    # all trees in one slice, and about one tree in each
        monkeypatch.setattr(trees, "SLICE_NODES", limit)
        got = {r.mail_id: r.prob for r in trees.scored(table, nodes, link, NAMES).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_tree_attribution_is_the_change_of_the_score(spark, table, fitted):
    nodes, link = trees.exported(fitted, scratch(spark))
    base = [0.1, 1.0, 0.5, 1.0]
    made = {r.mail_id: {c.feature: (c.value, c.contribution) for c in r.contributions} for r in trees.contributions(table, nodes, link, NAMES, base).collect()}
    whole = probabilities(fitted, table)
    for name, value in zip(NAMES, base, strict=True):
        other = table.withColumn(name, F.lit(value)).withColumn("features", array_to_vector(F.array(*NAMES)))
        less = probabilities(fitted, other)
        assert all(abs(made[k][name][1] - (whole[k] - less[k])) < 1e-9 for k in whole)
    assert all(m["d"][1] == 0 for m in made.values())        # a feature that no tree uses
    top = attribute.top_contributions(trees.contributions(table, nodes, link, NAMES, base), 2)
    assert top.count() == 600 and top.where("rank > 2").isEmpty()


def test_attribution_with_missing_values_and_no_rows(spark, table, fitted):
    nodes, link = trees.exported(fitted, scratch(spark))
    odd = spark.createDataFrame([(1, None, float("nan"), float("inf"), None), (None, 0.0, 0.0, 0.0, 0.0)], "mail_id long, a double, b double, c double, d double")
    got = trees.contributions(odd, nodes, link, NAMES, [0.0] * 4).collect()
    assert {c.contribution for r in got for c in r.contributions} == {0.0}
    assert trees.scored(odd.where("false"), nodes, link, NAMES).count() == 0


def test_linear_terms_score_like_the_pipeline(spark, table):
    model = learn.build("lr", {"max_iter": 50}, rows=300).fit(learn.with_class_weight(table))
    root = scratch(spark)
    assert registry.publish_model(model, NAMES, root, "m", {"model": "lr"}) == 1
    terms, record = registry.load(spark, root, "m")
    got = {r.mail_id: r.prob for r in registry.scored(table, terms, record).collect()}
    want = {r.mail_id: r.prob for r in learn.score(model, table).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want) and record["model"] == "lr" and record["features"] == NAMES


def test_centroid_terms(table):
    x = table.select("label", *NAMES).toPandas()
    terms, intercept = learn.centroid_terms(table, NAMES)
    one, zero = x[x.label == 1][NAMES].to_numpy(), x[x.label == 0][NAMES].to_numpy()
    pooled = (one.var(0) * len(one) + zero.var(0) * len(zero)) / len(x)
    want = np.where(pooled > 0, (one.mean(0) - zero.mean(0)) / np.where(pooled > 0, pooled, 1), 0)
    assert np.allclose([w for _, w in terms], want) and dict(terms)["d"] == 0
    assert np.isclose(intercept, np.log(len(one) / len(zero)) - (want * (one.mean(0) + zero.mean(0)) / 2).sum())
    with pytest.raises(ValueError):
        learn.centroid_terms(table.where("label = 1"), NAMES)


def test_versions_are_whole_and_never_replaced(spark):
    root = scratch(spark)
    terms = lambda w: spark.createDataFrame([("a", float(w))], registry.TERMS)
    record = {"kind": registry.LINEAR, "intercept": 0.5, "features": ["a"]}
    assert registry.versions(spark, root, "none") == []
    with ThreadPoolExecutor(4) as pool:                      # publishers at the same time get numbers of their own
        numbers = list(pool.map(lambda w: registry.publish(terms(w), {**record, "w": w}, root, "m"), range(6)))
    assert sorted(numbers) == list(range(1, 7)) == registry.versions(spark, root, "m")
    for w, n in enumerate(numbers):
        table, found = registry.load(spark, root, "m", n)
        assert (found["w"], found["version"], table.first().weight) == (w, n, float(w))
    assert registry.load(spark, root, "m")[1]["version"] == 6


def test_train_and_publish_keeps_the_best(spark, table):
    record = registry.train_and_publish(table, NAMES, scratch(spark), "mail", ["lr", "rf"], params={"lr": {"max_iter": 20}, "rf": {"n_estimators": 5, "max_depth": 3}}, k=2)
    assert record["model"] == max(record["scores"], key=lambda n: record["scores"][n]["cv_f1_mean"]) and record["version"] == 1
