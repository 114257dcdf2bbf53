"""Operators on DataFrames alone, the queries against DuckDB, and the pipeline."""

import hashlib

import corpus_pipeline
from compare import difference
from pyspark.sql import functions as F

from mailquarry.llm import exact, urlrules
from mailquarry.llm.components import components
from mailquarry.llm.queries import ORACLES, QUERIES

ROWS = [(1, "Same TEXT"), (2, "same text"), (3, None), (4, ""), (5, "É"), (6, "é"), (6, "é"), (None, "same text"), (7, "other")]


def test_exact_dedup(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, digest string, stay int")
    for digest in (None, F.substring(F.sha2("norm", 256), 1, 1), F.lit("one")):
        got = exact.dedup(df, digest=digest).collect()
        assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in got) == [(0, 2, 3), (1, 2, 3), (2, 2, 3), (3, 4, 2), (4, 4, 2), (5, 5, 1), (6, 6, 2), (6, 6, 2), (7, 7, 1)]
        assert sum(r.kept for r in got) == 5
        assert {r.text_sha256 for r in got if r.doc_id == 3} == {hashlib.sha256(b"").hexdigest()}
    assert sorted(r.doc_id for r in exact.keep_one(df).collect()) == [2, 4, 5, 6, 7] and exact.keep_one(df).columns == df.columns
    assert exact.dedup(df.where("false")).count() == 0


def test_oracles(spark, con, sf):
    for name, sql in ORACLES.items():
        assert difference(QUERIES[name](spark, sf).toPandas(), con.execute(sql).df()) is None, name


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1)], "a long, b long")
    assert sorted(map(tuple, components(links).collect())) == [(2, 1), (3, 1), (8, 7), (9, 7)]
    assert components(links.where("false")) is None


def test_url_rules(spark):
    rules = [urlrules.Rule("com", "/", "allow"), urlrules.Rule("example.com", "/en/", "block"), urlrules.Rule("www.example.com", "/en/", "allow")]
    urls = ["http://A.com/x", "http://a.com", "https://example.com/en/1?q", "http://www.EXAMPLE.com/en/", "http://sub.example.com/en/a", "http://notexample.com/en/", "http://bad.net/spam/1",
            "http://good.net/x", None, "no scheme", "http://x.org?a://b/c", "http://bad.net/spam/1"]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)], "page_id long, url string, tokens string")
    labelled = spark.createDataFrame([(f"http://bad.net/spam/{i}", "block") for i in range(20)] + [(f"http://good.net/ham/{i}", "allow") for i in range(20)], "url string, verdict string")
    got = {r.page_id: r for r in urlrules.judge(pages, rules, labelled).collect()}
    assert [got[i].rule for i in range(7)] == ["com/", None, "example.com/en/", "www.example.com/en/", "example.com/en/", "com/", None]
    assert [got[i].verdict for i in range(12)] == ["allow", "allow", "block", "allow", "block", "allow", "block", "allow", "allow", "allow", "allow", "block"]
    assert (got[8].host, got[8].path, got[10].host, got[10].path) == ("", "", "x.org", "")
    assert urlrules.judge(pages.where("false"), rules, labelled.where("false")).count() == 0


def test_pipeline(spark, sf):
    """Each stage on its own input: what it keeps has the columns, is a subset, and holds no more of what the stage removes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, {name: f for name, f in corpus_pipeline.STAGES}
    first = steps["language ID"](spark, docs, sf)
    assert first.columns == columns and first.count() >= 0.95 * docs.count()
    texts = exact.normalized()
    second = steps["exact dedup"](spark, docs, sf)
    assert second.count() == docs.select(texts).distinct().count() == second.select(texts).distinct().count()
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in steps["decontamination"](spark, docs, sf).collect()}
    assert clean == {r.doc_id for r in docs.collect() if not any(x in r.text for x in items)}
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
