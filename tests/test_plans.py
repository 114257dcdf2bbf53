"""Plans: no Python outside MIME and forest, pushed filters, no sort of a whole group, skewed keys."""

import pytest
from pyspark.sql import functions as F

from mailquarry.operators import corpus, evaluate, mime, reputation
from mailquarry.plans import fixtures, queries

NO_OTHER_PYTHON = ["mail_urls", "header_features", "url_mail_agg", "html_features", "urgency_score", "tfidf_weights", "url_unwrap_deep", "ioc_table", "score_mails"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_OTHER_PYTHON)
def test_python_for_unusual_mails_only_and_no_cartesian(spark, sf, name):
    # below every Python step stands the filter on unusual mails; no mail of the fixture passes it
    text = plan(queries.QUERIES[name](spark, sf)).split("Initial Plan")[0]
    lines = text.splitlines()
    python = [i for i, line in enumerate(lines) if "EvalPython" in line]
    assert all("decoded_parts(raw_email" in lines[i] or "decoded_headers(" in lines[i] for i in python)
    for i in python:
        below = next(line for line in lines[i + 1:] if "Filter" in line)
        assert "_odd" in below and "NOT" not in below
    for word in ("BatchEvalPython", "MapInPandas", "CartesianProduct"):
        assert word not in text


def test_no_mail_of_the_fixture_is_unusual(spark, sf):
    assert fixtures.mail_raw(spark, sf).where(mime.unusual(F.col("raw_email"))).isEmpty()


@pytest.mark.parametrize("name", ["mail_urls", "header_features", "url_mail_agg", "html_features", "urgency_score"])
def test_per_mail_work_does_not_shuffle(spark, sf, name):
    # the only exchange allowed is the fixture's round-robin spread of a small file
    text = plan(queries.QUERIES[name](spark, sf))
    assert "hashpartitioning" not in text and "SinglePartition" not in text


def test_filter_and_columns_reach_the_scan(spark, sf):
    text = plan(fixtures.table(spark, sf, "documents").where("lang = 'en'").select("doc_id"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text
    assert "text" not in text.split("ReadSchema")[1].splitlines()[0]


def test_hot_key_is_salted(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = spark.range(3000).select(F.col("id").alias("mail_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("url"))
        dim = spark.createDataFrame([("hot", 1), ("5", 2)], "url string, v int")
        out = reputation.lookup_join(facts, dim, "url")
        assert "_salt" in plan(out)
        assert out.count() == 3000
        assert out.where("v = 1").count() == 1000 and out.where("v = 2").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_exact_split_and_sample(spark):
    df = spark.range(5000).select(F.col("id").alias("mail_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    got = {(r["label"], r["split"]): r["n"] for r in corpus.stratified_split(df).groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, "train"): 3428, (0, "test"): 857, (1, "train"): 572, (1, "test"): 143}
    assert corpus.sample_exactly(df, 123).count() == 123
    sizes = [r["n"] for r in corpus.assign_folds(df, 3).groupBy("label", "fold").agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [238, 238, 239, 1428, 1428, 1429]


def test_auc_against_brute_force(spark):
    rows = [("m", i % 2, ((i * 37) % 50) / 50.0 if i % 5 else 0.5) for i in range(400)]
    got = evaluate.auc(spark.createDataFrame(rows, "model string, label int, prob double")).first()["auc_roc"]
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(want, abs=1e-6)


def test_dedup_is_idempotent_and_survives_a_hot_key(spark):
    df = spark.range(3000).select(
        F.col("id").alias("mail_id"), F.lit(0).alias("label"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("raw_email"),
        F.when(F.col("id") == 9, F.lit("best")).otherwise(F.lit("other")).alias("source"))
    once = corpus.drop_near_duplicates(df, {"best": 1})
    assert once.count() == 2001
    assert once.where("raw_email = 'same text'").first()["mail_id"] == 9
    assert corpus.drop_near_duplicates(once, {"best": 1}).count() == 2001
