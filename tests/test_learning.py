"""Learning, outliers and variants: statistics and brute force on small data."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.operators import evaluate, learn, text, unwrap, variants
from mailquarry.operators.outlier import OutlierForest, average_path
from mailquarry.plans import queries


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        y = int(i % 4 == 0)
        rows.append((i, y, [float(v) for v in rng.normal(2.5 * y, 1.0, 5)]))
    return spark.createDataFrame(rows, "mail_id long, label int, vec array<double>").cache()


def test_logistic_regression_separates(points):
    df = points.withColumn("features", array_to_vector("vec"))
    model = learn.build("lr").fit(learn.with_class_weight(df))
    assert evaluate.auc(learn.score(model, df).withColumn("model", F.lit("lr"))).first()["auc_roc"] > 0.95


def test_models_score_and_tune_after_an_observation(spark, points):
    from pyspark.sql import Observation
    spark.range(3).observe(Observation(), F.count(F.lit(1)).alias("n")).collect()        # a session with observations can't be serialised
    df = points.withColumn("features", array_to_vector("vec"))
    for name, params in (("lr", {}), ("rf", {"n_estimators": 3, "max_depth": 3}), ("gbt_plain", {"n_estimators": 2})):
        model = learn.build(name, params).fit(learn.with_class_weight(df))
        assert learn.score(model, df).count() == len(learn.score(model, df).collect()) == 240
    assert len(learn.tune("lr", df, trials=2, k=2)[1]) == 2
    assert learn.cross_validate("lr", df, k=2)["cv_f1_mean"] > 0.8


def test_forest_grows_in_groups_and_is_one_model(points, tmp_path):
    df = learn.with_class_weight(points.withColumn("features", array_to_vector("vec"))).repartition(7)
    model = learn.build("rf", {"n_estimators": 60, "max_depth": 4}).fit(df)
    assert model.stages[-1].getNumTrees == len(model.stages[-1].trees) == 60
    assert len({t.toDebugString.split("\n", 1)[1] for t in model.stages[-1].trees}) > 50               # each group has its own draws
    assert evaluate.auc(learn.score(model, df).withColumn("model", F.lit("rf"))).first()["auc_roc"] > 0.95
    model.write().overwrite().save(str(tmp_path / "m"))
    again = learn.score(PipelineModel.load(str(tmp_path / "m")), df)
    assert again.orderBy("mail_id").collect() == learn.score(model, df).orderBy("mail_id").collect()


def test_forest_fits_few_partitions(points, monkeypatch):
    """Every partition holds statistics of all open nodes; so small data is one partition, however it was dealt."""
    seen, real = [], learn.RandomForestClassifier._fit
    monkeypatch.setattr(learn.RandomForestClassifier, "_fit", lambda self, data: (seen.append((data.rdd.getNumPartitions(), self.getNumTrees())), real(self, data))[1])
    df = learn.with_class_weight(points.withColumn("features", array_to_vector("vec"))).repartition(7)
    learn.build("rf", {"n_estimators": 30, "max_depth": 2}).fit(df)
    assert sorted(seen) == [(1, 5), (1, 25)]


def test_nearest_is_exact(points):
    pts = points.select(F.col("mail_id").alias("id"), "vec")
    data = {r["id"]: np.array(r["vec"]) for r in pts.collect()}
    got = {}
    for r in learn.nearest(pts, pts, 3).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    for i, v in data.items():
        want = sorted((float(((v - w) ** 2).sum()), j) for j, w in data.items() if j != i)[:3]
        assert [got[i][k] for k in (1, 2, 3)] == [j for _, j in want]


def test_nearest_takes_any_number_of_points(spark):
    """More values than one 32 MB matrix, and copies of a point in several blocks."""
    x = (F.col("id") % 20_000).cast("double")
    pts = spark.range(70_000).select("id", F.array(x, *[F.lit(0.5)] * 63).alias("vec"))
    got = {(r["id"], r["rank"]): r["neighbour"] for r in learn.nearest(pts.where(F.col("id").isin(5, 20_005)), pts, 4).collect()}
    assert [got[5, r] for r in (1, 2, 3, 4)] == [20_005, 40_005, 60_005, 4]
    assert [got[20_005, r] for r in (1, 2, 3, 4)] == [5, 40_005, 60_005, 4]


def test_projected_neighbours_cover_most(points):
    pts = points.select(F.col("mail_id").alias("id"), "vec")
    pairs = lambda df: {(r["id"], r["neighbour"]) for r in df.collect()}
    exact, near = pairs(learn.nearest(pts, pts, 5)), pairs(learn.projected_neighbours(pts, 5, cell_rows=100))
    assert len(exact & near) / len(exact) > 0.6


def test_synthetic_rows_lie_on_segments(points):
    minority = points.where("label = 1")
    rows = learn.synthetic_rows(minority, 100).collect()
    data = {r["mail_id"]: np.array(r["vec"]) for r in minority.collect()}
    assert len(rows) == 100
    for r in rows:
        a, b = data[r["base"]], data[r["neighbour"]]
        assert np.allclose(np.array(r["vec"]), a + r["u"] * (b - a))


def test_oversample_balances(points):
    df = points.withColumn("features", array_to_vector("vec"))
    counts = {r["label"]: r["count"] for r in learn.oversample(df).groupBy("label").count().collect()}
    assert counts == {0: 180, 1: 180}


def test_outliers_score_high(spark, points, tmp_path):
    forest = OutlierForest.fit(points, trees=60)
    assert float(average_path(256)) == pytest.approx(10.244, abs=1e-2)
    odd = spark.createDataFrame([(-1, [30.0] * 5), (-2, [0.0] * 5)], "mail_id long, vec array<double>")
    scores = {r["mail_id"]: r["anomaly_score"] for r in forest.scores(odd).collect()}
    assert scores[-1] > 0.9 > scores[-2]
    forest.save(spark, str(tmp_path / "f"))
    again = OutlierForest.load(spark, str(tmp_path / "f")).scores(odd)
    assert {r["mail_id"]: r["anomaly_score"] for r in again.collect()} == pytest.approx(scores)
    top = [r["feature"] for r in forest.drivers(odd, [f"v{i}" for i in range(5)], top=2).collect()]
    assert len(top) == 4


def test_variants_change_only_what_they_should(spark):
    raw = "Subject: urgent\n\nDear PayPal user, verify now http://a.com/x expires"
    df = spark.createDataFrame([(1, raw)], "mail_id long, raw_email string")
    got = {r["attack"]: r["raw_email"] for r in variants.all_variants(df).collect()}
    assert got["clean"] == raw
    assert "Pay​Pal" in got["brand_mutation"]
    stripped = got["whitespace_insertion"]
    for z in L.ZERO_WIDTH:
        stripped = stripped.replace(z, "")
    assert stripped == raw
    assert any(r + "http://a.com/x" in got["url_obfuscation"] for r in L.REDIRECTORS)
    assert len(got["homoglyph_substitution"]) == len(raw)
    assert any("urgent" + f in got["urgency_dilution"] for f in L.URGENCY_FILLERS)


def test_unwrapping_is_idempotent(spark, sf):
    from mailquarry.plans import queries
    once = unwrap.clean_urls(queries.distinct_links(spark, sf)).select(F.col("cleaned").alias("url")).distinct()
    assert unwrap.clean_urls(once).where("was_wrapped").count() == 0


def test_random_grid_is_reproducible_and_in_range():
    a, b = learn.random_grid("rf", 20), learn.random_grid("rf", 20)
    assert a == b
    assert all(100 <= p["n_estimators"] <= 500 and p["max_features"] in ("sqrt", "log2") for p in a)


def test_every_model_has_a_search_space_and_exact_weights(spark):
    for name in learn.MODELS:
        assert len(learn.random_grid(name, trials=2)) == 2
    df = spark.createDataFrame([(0,)] * 3 + [(1,)] * 4, "label int")
    assert {r.label: r.weight for r in learn.with_class_weight(df).distinct().collect()} == {0: 7 / 6, 1: 7 / 8}


def test_model_queries_have_the_full_size(monkeypatch):
    """Registered with the defaults of the operators, all boosted presets included."""
    seen = []
    monkeypatch.setattr(queries, "_fit_and_score", lambda spark, d, name, params: seen.append((name, params)))
    for q in ("rf_scores", "gbt_scores", "gbt_leaf_scores", "gbt_plain_scores"):
        queries.QUERIES[q](None, "")
    assert seen == [(n, {}) for n in ("rf", "gbt_depth", "gbt_leaf", "gbt_plain")]

    class Done(Exception):
        pass

    def stop(*args, **kwargs):
        seen.append((args[0], kwargs))
        raise Done

    monkeypatch.setattr(queries, "training", lambda spark, d: None)
    monkeypatch.setattr(learn, "tune", stop)
    monkeypatch.setattr(learn, "cross_validate", stop)
    for q in ("param_grid", "cross_validation"):
        with pytest.raises(Done):
            queries.QUERIES[q](None, "")
    assert seen[4:] == [("lr", {"trials": 50, "k": 3}), ("lr", {"k": 3})]


def test_domain_filter_copies_no_derivation(spark, sf):
    """The test for links without a domain stays above the generator, so no registered domain is derived in a filter."""
    plan = queries.named_domains(spark.createDataFrame([("http://a.example.com",), ("http://10.0.0.1/",)], "url string"))
    filters = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filters and not any("regexp_extract" in line for line in filters)
    assert [r.domain for r in plan.collect()] == ["example.com"]


def test_picks_equal_single_picks(spark):
    from mailquarry.functions.mix import begun, pick, pick_at, picks
    start = begun(F.lit(42), F.lit(1), F.col("id"))
    row = spark.range(7, 8).select(picks(10, start, F.lit(50)).alias("many"), F.array(*[pick(10, F.lit(42), F.lit(1), F.col("id"), F.lit(i)) for i in range(50)]).alias("single"),
                                   F.array(*[pick_at(10, start, F.lit(i)) for i in range(50)]).alias("at")).first()
    assert row.many == row.single == row.at


def test_variants_of_odd_mails(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no body"), (4, "h: 1\n\n"), (5, "h: 1\n\nsome letters " * 20)], "mail_id long, raw_email string")
    for attack in ("whitespace_insertion", "homoglyph_substitution"):
        got = {r.mail_id: r.raw_email for r in variants.apply(df, attack).collect()}
        assert got[1] is None and got[2] == "" and got[4].startswith("h: 1"[:1]) and got[5] != "h: 1\n\nsome letters " * 20


@pytest.mark.parametrize("size, known", [(4, 5000), (4, 0), (1000, 5000)])
def test_vocabulary_leaves_out_rare_pairs_before_they_are_counted(spark, monkeypatch, size, known):
    from collections import Counter
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.6, 60) % 90) for _ in range(40)] + ["", None, "once", "twice twice", "w1 w1 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(text, "KNOWN_WORDS", known)
    seen, real = [], text._counted
    monkeypatch.setattr(text, "_counted", lambda rows, values: (seen.append(rows), real(rows, values))[1])
    words = [(t or "").split() for t in texts]
    lists = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in words]
    tf, df = Counter(t for x in lists for t in x), Counter(t for x in lists for t in set(x))
    want = sorted(((t, n, df[t]) for t, n in tf.items() if df[t] >= 2), key=lambda r: (-r[1], r[0]))[:size]
    vocabulary = text.tfidf_vocabulary(docs, "doc_id", "text", size)
    assert sorted((r.term, r.tf, r.df) for r in vocabulary.collect()) == sorted(want)
    counted = seen[1].select(F.sum(F.size("_w"))).first()[0]
    assert counted < 0.8 * sum(max(len(w) - 1, 0) for w in words) if (size, known) == (4, 5000) else counted > 0
    got = {(r.doc_id, r.term) for r in text.tfidf_weights(docs, "doc_id", "text", vocabulary).collect()}
    assert got == {(i, t) for i, x in enumerate(lists) for t in set(x) & {w[0] for w in want}}
