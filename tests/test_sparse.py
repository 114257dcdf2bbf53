"""Sparse vectors over an ordered vocabulary, against plain Python."""

import math
from collections import Counter

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from mailquarry.operators import sparse
from mailquarry.plans import registry
from mailquarry.plans.staging import scratch

TEXTS = {1: "red fish blue fish", 2: "blue fish", 3: None, 4: "", 5: "zebra only here", 6: "red fish blue fish", 7: "fish " * 30_000}


def terms(text):
    words = (text or "").split()
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "mail_id long, text string")


def test_weights_against_plain_python(docs):
    counts = Counter(t for x in TEXTS.values() for t in terms(x))
    df = Counter(t for x in TEXTS.values() for t in set(terms(x)))
    order = sorted((t for t in counts if df[t] >= 2), key=lambda t: (-counts[t], t))[:4]
    vocabulary = sparse.ordered_vocabulary(docs, "mail_id", "text", size=4)
    assert [r.term for r in vocabulary.orderBy("pos").collect()] == sorted(order)
    pos = {t: i for i, t in enumerate(sorted(order))}
    idf = {t: math.log((len(TEXTS) + 1) / (df[t] + 1)) + 1 for t in order}
    got = {r.doc_id: r for r in sparse.tfidf_rows(docs, "mail_id", "text", vocabulary).collect()}
    assert set(got) == set(TEXTS)
    for key, text in TEXTS.items():
        mine = Counter(t for t in terms(text) if t in pos)
        raw = {pos[t]: (1 + math.log(n)) * idf[t] for t, n in mine.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        assert dict(zip(got[key].tfidf.indices, got[key].tfidf.values)) == pytest.approx({i: v / norm for i, v in raw.items()})
        assert list(got[key].tfidf.indices) == sorted(raw)
        assert (got[key].n_terms, got[key].n_unseen) == (len(terms(text)), len(terms(text)) - sum(mine.values()))


def test_no_known_terms_at_all(spark, docs):
    vocabulary = sparse.ordered_vocabulary(docs.where("mail_id IN (3, 4)"), "mail_id", "text")
    got = sparse.tfidf_rows(docs, "mail_id", "text", vocabulary)
    assert all(r.tfidf.indices == [] and r.n_unseen == r.n_terms for r in got.collect())
    assert sparse.tfidf_rows(docs.limit(0), "mail_id", "text", vocabulary).isEmpty()


def test_layout_of_the_vector(spark):
    table = spark.createDataFrame([(1, 0.0, 2.5, [1.0, 0.0, 3.0], ([0, 2], [0.6, 0.8])), (2, float("nan"), None, None, None), (3, 1.0, float("inf"), [float("nan"), 7.0], ([], []))],
                                  "mail_id long, a double, b double, e array<double>, w struct<indices: array<int>, values: array<double>>")
    parts = sparse.feature_rows(table, ["a", "b"], "e", 2, "w", 3)
    vectors = sparse.as_vectors(parts.select("mail_id", "features"), scratch(spark))
    got = {r.mail_id: r.features for r in vectors.collect()}
    assert got == {1: SparseVector(7, {1: 2.5, 2: 1.0, 4: 0.6, 6: 0.8}), 2: SparseVector(7, {}), 3: SparseVector(7, {0: 1.0, 3: 7.0})}
    assert {(r["mail_id"], r["index"], r["value"]) for r in sparse.vector_entries(vectors, ["mail_id"]).collect()} == {
        (1, 1, 2.5), (1, 2, 1.0), (1, 4, 0.6), (1, 6, 0.8), (3, 0, 1.0), (3, 3, 7.0)}


def test_plan_neither_shuffles_nor_runs_python(docs):
    vocabulary = sparse.ordered_vocabulary(docs, "mail_id", "text")
    text = sparse.tfidf_rows(docs, "mail_id", "text", vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_versions_of_a_vocabulary(spark, docs):
    root = scratch(spark)
    first = sparse.ordered_vocabulary(docs, "mail_id", "text", size=2)
    assert registry.publish_vocabulary(first, ["a"], 8, root, "terms") == 1
    assert registry.publish_vocabulary(sparse.ordered_vocabulary(docs, "mail_id", "text", size=3), ["a"], 8, root, "terms") == 2
    table, record = registry.load(spark, root, "terms", 1)
    assert table.count() == 2 and (record["features"], record["embedding_dim"], record["kind"]) == (["a"], 8, registry.VOCABULARY)
    with pytest.raises(ValueError):
        sparse.tfidf_rows(docs, "mail_id", "text", table.where(F.col("pos") > 0))
