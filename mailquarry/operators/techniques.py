"""Attack techniques of a mail: presence rules, feature rules, feature map, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import rows as R
from mailquarry.functions import text as X

PHISHING_ENTRY = ["T1566", "T1566.001", "T1566.002", "T1566.003"]
MIN_CONFIDENCE = 0.05


def technique_url(technique_id: Column) -> Column:
    return F.concat(F.lit(L.TECHNIQUE_URL), F.replace(technique_id, F.lit("."), F.lit("/")), F.lit("/"))


def by_presence(arrays: DataFrame) -> DataFrame:
    """Techniques that follow from having links, attachments or domains at all."""
    present = {"url": F.size("ioc_urls") > 0, "attachment": F.size("attachment_hashes") > 0, "domain": F.size("domains") > 0}
    found = F.array(*[
        F.when(present[kind], F.struct(F.lit(tid).alias("technique_id"), F.lit(name).alias("technique_name"),
                                       F.lit(tactic).alias("tactic"), F.lit(kind).alias("indicator")))
        for tid, name, tactic, kind in L.PRESENCE_TECHNIQUES])
    return R.explode_structs(arrays, ["mail_id"], F.array_compact(found), "technique_id")


def _technique(tid: str, name: str, tactic: str, confidence: Column, evidence: Column) -> Column:
    return F.struct(F.lit(tid).alias("technique_id"), F.lit(name).alias("technique_name"), F.lit(tactic).alias("tactic"),
                    F.round(confidence.cast("double"), 6).alias("confidence"), evidence.alias("evidence"))


def _evidence(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(text)) for cond, text in pairs]))


def _no_array() -> Column:
    return F.array().cast("array<struct<technique_id:string,technique_name:string,tactic:string,confidence:double,evidence:array<string>>>")


def rule_array() -> Column:
    """The eleven rules over feature columns, as an array of technique structs.

    Needs the feature table plus ``prob``, ``verdict``, ``n_urls``, ``n_attachments`` and ``ai_brand`` (NULL when unknown).
    """
    c = F.col
    urgency = c("txt_urgency_score_normalised")
    keywords, form = c("url_suspicious_keywords_in_url_max"), c("html_external_form_action") > 0
    brand = _evidence((c("url_brand_in_subdomain_max") > 0, "brand_in_subdomain=True"),
                      (c("url_cert_brand_mismatch") > 0, "cert_brand_mismatch=True"),
                      (c("url_punycode_detected_max") > 0, "punycode_domain=True"))
    brand = F.concat(F.when(c("ai_brand").isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("ai_brand="), c("ai_brand")))), brand)
    hidden = _evidence((c("html_base64_content_count") > 0, "base64_html_content=True"), (c("html_hidden_text_count") > 0, "hidden_text=True"),
                       (c("html_javascript_count") > 2, "javascript_obfuscation=True"), (c("url_url_entropy_max") > 4.5, "high_url_entropy=True"))
    auth = _evidence((c("hdr_spf_result") < 0, "spf_fail=True"), (c("hdr_dkim_result") < 0, "dkim_fail=True"), (c("hdr_dmarc_result") < 0, "dmarc_fail=True"))
    number = lambda name, col: F.array(F.concat(F.lit(f"{name}="), col.cast("int").cast("string")))
    rules = [
        ("T1566", c("verdict").isin("PHISHING", "UNCERTAIN"), F.bround(F.least(c("prob"), F.lit(1.0)), 2),
         F.array(F.concat(F.lit("ml_probability="), X.percent(c("prob"), 1)))),
        ("T1566.001", c("n_attachments") > 0, F.lit(0.85), number("attachment_count", c("n_attachments"))),
        ("T1566.002", c("n_urls") > 0, F.least(F.lit(0.5) + F.lit(0.1) * c("n_urls"), F.lit(0.95)), number("url_count", c("n_urls"))),
        ("T1036", F.size(brand) > 0, F.lit(0.80), brand),
        ("T1204", urgency > 0.3, F.least(urgency, F.lit(0.9)), F.array(F.concat(F.lit("urgency_score="), F.format_string("%.3f", F.bround(urgency, 3))))),
        ("T1056", form, F.lit(0.75), F.array(F.lit("external_form_action=True"))),
        ("T1027", F.size(hidden) > 0, F.lit(0.70), hidden),
        ("T1078", keywords > 0, F.lit(0.60), number("suspicious_url_keywords", keywords)),
        ("T1071.003", F.size(auth) > 0, F.lit(0.65), auth),
        ("T1598", form & (keywords > 0), F.lit(0.72), F.array(F.lit("external_form_action=True"), F.lit("suspicious_url_keywords=True"))),
        ("T1539", form & (urgency > 0.5), F.lit(0.68), F.array(F.lit("external_form_action=True"), F.lit("high_urgency=True"))),
    ]
    return F.array_compact(F.array(*[
        F.when(cond, _technique(tid, *L.TECHNIQUES[tid], confidence, evidence)) for tid, cond, confidence, evidence in rules]))


def map_array(rules: Column) -> Column:
    """Techniques of the feature map whose id is not already in ``rules``; the first feature of an id wins."""
    out, seen = [], F.transform(rules, lambda t: t["technique_id"])
    earlier: dict[str, Column] = {}
    for feature, (tid, name, tactic) in L.FEATURE_TECHNIQUES.items():
        on = F.coalesce(F.col(feature).cast("double") > 0, F.lit(False))
        fresh = on & ~F.array_contains(seen, tid) & ~earlier.get(tid, F.lit(False))
        out.append(F.when(fresh, _technique(tid, name, tactic, F.lit(0.65), F.array(
            F.concat(F.lit(f"{feature}="), F.col(feature).cast("double").cast("string"))))))
        earlier[tid] = earlier.get(tid, F.lit(False)) | on
    return F.array_compact(F.array(*out))


def with_techniques(scored: DataFrame) -> DataFrame:
    """Add ``techniques`` (rules, then feature map), each mail in its own row."""
    df = scored.withColumn("_rules", F.coalesce(rule_array(), _no_array()))
    return df.withColumn("techniques", F.concat("_rules", map_array(F.col("_rules")))).drop("_rules")


def calibrate(df: DataFrame, threshold: float = L.PHISHING_THRESHOLD) -> DataFrame:
    """Scale confidences to the verdict; weak entries and, for legitimate mail, entry techniques go."""
    prob, verdict = F.col("prob"), F.col("verdict")
    low = F.least(F.lit(0.30), F.greatest(F.lit(0.05), prob) * 3.0)
    mid = F.least(F.lit(1.0), F.greatest(F.lit(0.45), prob / threshold))

    def scaled(t: Column) -> Column:
        conf = (F.when(verdict == "LEGITIMATE", F.bround(t["confidence"] * low, 2))
                .when(verdict == "UNCERTAIN", F.bround(F.least(t["confidence"] * mid, F.lit(0.80)), 2))
                .otherwise(t["confidence"]))
        return F.struct(t["technique_id"].alias("technique_id"), t["technique_name"].alias("technique_name"),
                        t["tactic"].alias("tactic"), conf.alias("confidence"), t["evidence"].alias("evidence"))

    def kept(t: Column) -> Column:
        strong = (verdict == "PHISHING") | (t["confidence"] >= MIN_CONFIDENCE)
        return strong & ~((verdict == "LEGITIMATE") & t["technique_id"].isin(PHISHING_ENTRY))

    return df.withColumn("techniques", F.filter(F.transform("techniques", scaled), kept))


def technique_rows(df: DataFrame) -> DataFrame:
    """Long table ``mail_id, technique_id, technique_name, tactic, confidence, evidence, url``."""
    return R.explode_structs(df, ["mail_id"], F.col("techniques"), "technique_id").withColumn("url", technique_url(F.col("technique_id")))


def prevalence(rows: DataFrame) -> DataFrame:
    """Mails and mean confidence per technique, with a total per tactic (technique 'ALL')."""
    return (rows.rollup("tactic", "technique_id")
            .agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
                 F.grouping_id().alias("_g"))
            .where(F.col("_g") < 3)
            .select("tactic", F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col("technique_id")).alias("technique_id"),
                    "n", "mean_confidence"))
