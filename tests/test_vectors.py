"""Kept vectors: computed once by content, atomic batches, lost races."""

import numpy as np
import pytest

from mailquarry.operators import embedding
from mailquarry.plans import registry, vectors
from mailquarry.plans.staging import scratch


def models():
    def make():
        def predict(texts):
            assert all(t.strip() for t in texts)
            return np.array([[len(t), t.count("a")] for t in texts], np.float32)
        return predict
    return make                 # a local function, which goes to the workers by value


counting_model = models()


@pytest.fixture()
def docs(spark):
    long = "a " * 5000
    return spark.createDataFrame([(1, "banana"), (2, "banana"), (3, None), (4, ""), (5, " \n\t"), (6, "kiwi"), (7, long), (8, long + "tail is cut")], "mail_id long, text string")


def test_each_text_once(spark, docs):
    root = scratch(spark)
    assert vectors.stored(spark, root, "m").isEmpty()
    assert vectors.refresh(docs, "text", root, "m", counting_model) == 3            # the two long texts begin alike
    assert vectors.refresh(docs, "text", root, "m", counting_model) == 0
    assert registry.versions(spark, root, "m") == [1]
    more = docs.unionByName(spark.createDataFrame([(9, "papaya")], "mail_id long, text string"))
    assert vectors.refresh(more, "text", root, "m", counting_model) == 1
    assert vectors.refresh(docs, "text", root, "other", counting_model) == 3
    got = {r.mail_id: r.embedding for r in embedding.with_vectors(more, "text", vectors.stored(spark, root, "m"), 2).collect()}
    assert (got[1], got[2], got[6], got[9]) == ([6, 3], [6, 3], [4, 0], [6, 3])
    assert got[3] == got[4] == got[5] == [0, 0] and len(got) == 9


def test_empty_table(spark, docs):
    root = scratch(spark)
    assert vectors.refresh(docs.limit(0), "text", root, "m", counting_model) == 0
    assert registry.versions(spark, root, "m") == []


def test_lost_race_adds_only_what_is_missing(spark, docs, monkeypatch):
    root, real = scratch(spark), registry.appeared
    def other_first(*args):
        monkeypatch.setattr(registry, "appeared", real)
        assert vectors.refresh(docs.where("mail_id = 6"), "text", root, "m", counting_model) == 1
        return real(*args)
    monkeypatch.setattr(registry, "appeared", other_first)
    assert vectors.refresh(docs, "text", root, "m", counting_model) == 2
    table = vectors.stored(spark, root, "m")
    assert registry.versions(spark, root, "m") == [1, 2]
    assert (table.count(), table.select("text_hash").distinct().count()) == (3, 3)
