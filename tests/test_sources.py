"""Readers, sinks and verdict logic on small inputs."""

import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mailquarry.operators import clean, corpus, learn, reputation, verdict
from mailquarry.sinks import exports
from mailquarry.sources import corpora


def test_csv_discovers_columns_and_drops_unknown_labels(spark, tmp_path):
    (tmp_path / "b.csv").write_text('Category,Message \nspam,"two\nlines, quoted ""x"""\nham,hello\n??,lost\nphishing,   \n')
    rows = corpora.csv_corpus(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "s").collect()
    assert sorted((r["label"], r["raw_email"], r["source"]) for r in rows) == [(0, "hello", "s"), (1, 'two\nlines, quoted "x"', "s")]


def test_missing_or_unusable_input_gives_an_empty_corpus(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    for path in ("nowhere.csv", "x.csv"):
        df = corpora.csv_corpus(spark, [str(tmp_path / path)], "s")
        assert df.columns == ["label", "raw_email", "source"] and df.count() == 0


def test_label_column_may_be_missing(spark, tmp_path):
    spark.createDataFrame([("mail one",), ("mail two",)], "text string").write.parquet(str(tmp_path / "p"))
    assert {r["label"] for r in corpora.parquet_corpus(spark, [str(tmp_path / "p")], "s", label_if_missing=1).collect()} == {1}


def test_folder_blob_and_mbox(spark, tmp_path):
    (tmp_path / "ham").mkdir()
    (tmp_path / "ham" / "1").write_bytes(b"From: a\n\nok \xff byte")
    (tmp_path / "box").write_text("From a Mon\nSubject: 1\n\nfirst\n\nFrom b Tue\nSubject: 2\n\nsecond\n")
    (tmp_path / "blob.txt").write_text("short\n\n" + "x" * 60 + "\n\n" + "y" * 50)
    got = corpora.ham_and_spam(spark, [str(tmp_path / "ham")], [], "sa", spam_mbox=str(tmp_path / "box")).collect()
    assert sorted((r["label"], r["raw_email"].strip()) for r in got) == [
        (0, "From: a\n\nok � byte"), (1, "Subject: 1\n\nfirst"), (1, "Subject: 2\n\nsecond")]
    assert corpora.blob_corpus(spark, [str(tmp_path / "blob.txt")], "nf").count() == 2


def test_column_search():
    assert clean.find_column(["ID", " Email_Text "], ["email_text"]) == " Email_Text "
    assert clean.find_column(["is_spam_flag", "t"], ["spam"], substring=True) == "is_spam_flag"
    assert clean.find_column(["a"], ["b"]) is None


def test_split_and_manifest_are_written(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("mail_id"), (F.col("id") % 2).cast("int").alias("label"), F.lit("x").alias("raw_email"), F.lit("s").alias("source"))
    parts = corpus.stratified_split(df)
    exports.write_split(parts, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("split = 'test'").count() == 10
    exports.write_json(corpus.corpus_manifest(parts), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).agg(F.sum("total")).first()[0] == 50


def test_models_can_be_stored(spark, tmp_path):
    df = spark.range(60).select(F.col("id").alias("mail_id"), (F.col("id") % 2).cast("int").alias("label"), array_to_vector(F.array((F.col("id") % 2) * 2.0, F.col("id") % 7 * 1.0)).alias("features"))
    model = learn.build("rf", {"n_estimators": 3, "max_depth": 3}).fit(learn.with_class_weight(df))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = learn.score(PipelineModel.load(str(tmp_path / "m")), df)
    assert again.orderBy("mail_id").collect() == learn.score(model, df).orderBy("mail_id").collect()


def test_event_json(spark):
    arrays = spark.createDataFrame([(1, ["a@x.com"], ["8.8.8.8"], [f"http://u{i}" for i in range(60)], [], ["d.com"])],
                                   "mail_id long, sender_emails array<string>, sender_ips array<string>, ioc_urls array<string>, attachment_hashes array<string>, domains array<string>")
    for cap, links in ((None, 60), (50, 50)):
        event = json.loads(exports.misp_json(arrays, "2024-06-01T00:00:00Z", cap=cap).first()["event"])["Event"]
        kinds = [a["type"] for a in event["Attribute"]]
        assert (event["date"], kinds.count("url"), kinds.count("domain")) == ("2024-06-01", links, 1)


@pytest.fixture(scope="module")
def facts(spark):
    base = {"prob": 0.5, "ai_is_phishing": -1, "ai_confidence": -1.0, "hdr_spf_result": 0, "hdr_dkim_result": 0, "hdr_dmarc_result": 0}
    tools = {f"{t}_verdict": "N/A" for t in reputation.TOOLS}
    def run(**changes):
        row = {**base, **tools, **changes}
        df = spark.createDataFrame([tuple(row.values())], ", ".join(
            f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in row.items()))
        r = verdict.composite_verdict(df).first()
        return r["verdict"], round(r["adjusted_prob"], 6)
    return run


def test_composite_verdict(facts):
    assert facts() == ("UNCERTAIN", 0.5)
    assert facts(vt_verdict="MALICIOUS") == ("PHISHING", 0.9)
    assert facts(vt_verdict="CLEAN", gsb_verdict="CLEAN", urlhaus_verdict="CLEAN") == ("LEGITIMATE", 0.35)
    assert facts(ai_is_phishing=1, ai_confidence=0.8) == ("PHISHING", 0.7)
    assert facts(hdr_spf_result=-1, hdr_dkim_result=-1) == ("PHISHING", 0.66)
    assert facts(hdr_spf_result=1, hdr_dkim_result=1) == ("UNCERTAIN", 0.42)


def test_a_clean_answer_never_raises_the_score(facts):
    for tool in reputation.TOOLS:
        for rest in ({}, {"ipqs_verdict": "SUSPICIOUS", "urlscan_verdict": "SUSPICIOUS"}, {"gsb_verdict": "CLEAN", "urlhaus_verdict": "CLEAN"}):
            before = {**rest, f"{tool}_verdict": "N/A"}
            assert facts(**{**before, f"{tool}_verdict": "CLEAN"})[1] <= facts(**before)[1]
