"""The whole scoring job over a table of raw mails."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import net, rows
from mailquarry.operators import features, findings, indicators, mail, reputation, techniques, urls, verdict


@dataclass
class Snapshots:
    """Answers of look-up services, as tables."""

    url_rep: DataFrame
    blocklist: DataFrame
    url_scan: DataFrame
    malware_urls: DataFrame
    ip_rep: DataFrame
    fraud_rep: DataFrame
    whois: DataFrame | None = None
    cert_log: DataFrame | None = None
    ai_answers: DataFrame | None = None
    as_of: str = "1970-01-01"


def fraud_keys(parsed: DataFrame) -> DataFrame:
    """``mail_id, kind, key``: first link, From address and sender address of each mail."""
    kinds = F.array(
        F.struct(F.lit("url").alias("kind"), F.get("urls", F.lit(0)).alias("key")),
        F.struct(F.lit("email").alias("kind"), F.regexp_extract("from_address", net.ADDRESS, 0).alias("key")),
        F.struct(F.lit("ip").alias("kind"), mail.sender_ip(F.col("received")).alias("key")))
    return rows.explode_structs(parsed, ["mail_id"], F.filter(kinds, lambda k: k["key"].isNotNull()), "key")


def fraud_scores(parsed: DataFrame, fraud_rep: DataFrame) -> DataFrame:
    """Per mail: ``fraud_url_score``, ``fraud_url_flag``, ``fraud_email_score``, ``fraud_ip_score``."""
    hits = reputation.rep_fraud(fraud_keys(parsed), fraud_rep)
    best = lambda kind, column: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(column))), F.lit(-1))
    return hits.groupBy("mail_id").agg(
        best("url", "fraud_score").alias("fraud_url_score"), best("url", "fraud_flag").alias("fraud_url_flag"),
        best("email", "fraud_score").alias("fraud_email_score"), best("ip", "fraud_score").alias("fraud_ip_score"))


def lookup_features(parsed: DataFrame, snap: Snapshots, suffixes: Iterable[str] | None = None) -> list[DataFrame]:
    """Look-up features of the mails, one narrow table per kind with one row per mail."""
    intel = reputation.intel_features(parsed, mail.link_rows(parsed), snap.url_rep, snap.blocklist, snap.url_scan, snap.malware_urls, snap.ip_rep)
    return [intel, *domain_features(parsed, snap, suffixes)]


def domain_features(parsed: DataFrame, snap: Snapshots, suffixes: Iterable[str] | None = None) -> list[DataFrame]:
    """The part of :func:`lookup_features` that follows from the domains of a mail's links: registration and certificates."""
    domains, out = urls.mail_domains(parsed, suffixes), []
    if snap.whois is not None:
        out.append(urls.worst_whois(urls.whois_risk(domains, snap.whois, snap.as_of)))
    if snap.cert_log is not None:
        out.append(urls.worst_cert(urls.cert_risk(domains, snap.cert_log, snap.as_of)))
    return out


def feature_table(parsed: DataFrame, snap: Snapshots | None = None, suffixes: Iterable[str] | None = None,
                  keep: tuple[str, ...] = ("mail_id",)) -> DataFrame:
    """Named scalar features of parsed mails, with look-up features when snapshots are given."""
    table = features.scalar_features(parsed, suffixes, keep)
    if snap is None:
        return table
    return features.with_lookups(table, *lookup_features(parsed, snap, suffixes)).select(*table.columns)


def mail_facts(parsed: DataFrame, suffixes: Iterable[str] | None = None) -> DataFrame:
    """Everything that follows from the mail alone: features and indicators, without the texts.

    One chain of projections; the bodies end here and are never shuffled.
    """
    fields = ("mail_id", "from_address", "reply_to", "return_path", "x_mailer", "subject")
    raw = ("raw_email", "x_originating_ip", "received", "body_text", "body_html", "urls", "attachments")
    table = features.scalar_features(parsed, suffixes, (*fields, *raw))
    arrays = indicators.indicator_arrays(table, keep=tuple(c for c in table.columns if c not in raw))
    return arrays.select("*", F.size("ioc_urls").alias("n_urls"), F.size("attachment_hashes").alias("n_attachments"))


def with_snapshots(facts: DataFrame, parsed: DataFrame, snap: Snapshots, suffixes: Iterable[str] | None = None) -> DataFrame:
    """Add look-up features, fraud scores and stored AI answers to the facts of the mails."""
    df = features.with_lookups(facts, *lookup_features(parsed, snap, suffixes))
    df = df.join(fraud_scores(parsed, snap.fraud_rep), "mail_id", "left").fillna(
        -1, ["fraud_url_score", "fraud_url_flag", "fraud_email_score", "fraud_ip_score"])
    if snap.ai_answers is not None:
        return verdict.ai_answers(df, snap.ai_answers)
    return df.select("*", F.lit(-1).alias("ai_is_phishing"), F.lit(-1.0).alias("ai_confidence"), F.lit(None).cast("string").alias("ai_brand"))


def technique_facts(parsed: DataFrame, snap: Snapshots, suffixes: Iterable[str] | None = None) -> DataFrame:
    """The facts of the mails with those look-ups alone that technique rules read; every other one is a join that changes none of them."""
    return features.with_lookups(mail_facts(parsed, suffixes), *domain_features(parsed, snap, suffixes))


def score_mails(parsed: DataFrame, snap: Snapshots, probability: Callable[[], Column],
                suffixes: Iterable[str] | None = None) -> DataFrame:
    """Verdict, probability, techniques, findings and indicators for every mail.

    ``probability`` gives the model's probability from the feature columns. For a Spark ML model, score the
    feature table first and pass the joined column. ``parsed`` is read by several branches: pass a written
    table.
    """
    df = with_snapshots(mail_facts(parsed, suffixes), parsed, snap, suffixes).withColumn("prob", probability())
    df = reputation.tool_verdicts(df).withColumn("verdict", verdict.ml_verdict(F.col("prob"), L.PHISHING_THRESHOLD, L.UNCERTAIN_THRESHOLD))
    df = techniques.calibrate(techniques.with_techniques(df))
    df = findings.with_address_findings(df).select("*", findings.header_findings().alias("header_findings"),
                   findings.html_findings().alias("html_findings"), urls.triaged_links(F.col("ioc_urls"), suffixes).alias("triage"))
    df = df.withColumn("summary", findings.summary_findings()).withColumnRenamed("verdict", "ml_verdict")
    return verdict.composite_verdict(df)
