"""Each query against its DuckDB statement, on the small data set."""

import pytest
from compare import check

from mailquarry.operators import features
from mailquarry.plans import queries

# One or two per family by default; ``python tests/compare.py`` runs all of them.
SELECTED = ["src_csv_corpus", "src_mbox", "dedup_prefix200", "stratified_split", "kfold_assign", "mail_headers", "mail_parts", "mail_urls", "header_features",
            "registered_domain", "url_mail_agg", "url_unwrap_deep", "url_triage", "html_features", "subject_features", "tfidf_weights", "rep_blocklist",
            "knn5", "auc_rank", "confusion_metrics", "linear_attribution", "ioc_table", "header_findings", "verdict_ml", "variant_filler",
            "variant_zero_width", "variant_lookalikes", "export_misp", "export_text", "metrics_record", "metrics_file", "split_files", "src_ham_spam", "src_parquet_corpus",
            "src_optional_label", "src_prepared", "encoded_words", "rank_agreement", "mail_bodies", "attack_simple"]


@pytest.mark.parametrize("name", SELECTED)
def test_matches_oracle(spark, con, sf, name):
    diff, _, _, _ = check(spark, con, name, sf)
    assert diff is None, diff


def test_registry():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert len(queries.QUERIES) >= 120


def test_failure_modes_rank_every_feature(spark, con, sf):
    assert {*features.SCALARS, *features.INTEL} == set(queries._FAIL)
    diff, _, _, _ = check(spark, con, "failure_modes", sf)
    assert diff is None, diff
