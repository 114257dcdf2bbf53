"""Exports: event JSON, CEF lines, text reports, manifests and split files.

Export sections hold every entry unless a ``cap`` is given; they are cut inside the row of a mail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import rows
from mailquarry.functions import text as X

PRODUCT = "mailquarry"


def _attributes(values: Column, kind: str, category: str, comment: str) -> Column:
    return F.transform(values, lambda v: F.struct(
        F.lit(kind).alias("type"), F.lit(category).alias("category"), v.alias("value"), F.lit(comment).alias("comment"), F.lit(True).alias("to_ids")))


def event_attributes(arrays: DataFrame, cap: int | None = None) -> DataFrame:
    """Add ``attributes``: the entries of a threat-sharing event, with ``cap`` at most as many links and domains."""
    hashes = F.filter("attachment_hashes", lambda h: h.isNotNull())
    return arrays.withColumn("attributes", F.concat(
        _attributes(F.col("sender_emails"), "email-src", "Payload delivery", "sender address"),
        _attributes(F.col("sender_ips"), "ip-src", "Network activity", "relay address"),
        _attributes(rows.first("ioc_urls", cap), "url", "External analysis", "link"),
        _attributes(rows.first("domains", cap), "domain", "Network activity", "link domain"),
        _attributes(hashes, "sha256", "Payload delivery", "attachment")))


def misp_json(arrays: DataFrame, timestamp: str, campaign: str = f"{PRODUCT} detection", cap: int | None = None) -> DataFrame:
    """``mail_id, event``: one event JSON per mail."""
    event = F.struct(
        F.lit(campaign).alias("info"), F.lit(timestamp[:10]).alias("date"), F.lit("2").alias("threat_level_id"), F.lit("1").alias("analysis"),
        F.lit("0").alias("distribution"), F.col("attributes").alias("Attribute"),
        F.array(F.struct(F.lit("phishing").alias("name")), F.struct(F.lit(PRODUCT).alias("name"))).alias("Tag"))
    return event_attributes(arrays, cap).select("mail_id", F.to_json(F.struct(event.alias("Event"))).alias("event"))


def cef_lines(arrays: DataFrame, timestamp: str) -> DataFrame:
    """``mail_id, line``: one CEF line per mail; needs ``verdict``."""
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit("unknown"))
    return arrays.select("mail_id", F.concat(
        F.lit(f"CEF:0|{PRODUCT}|{PRODUCT}|1.0|phishing_detection|"), F.col("verdict"), F.lit(f"|10|rt={timestamp} src="), first("sender_ips"),
        F.lit(" suser="), first("sender_emails"), F.lit(" cnt="), F.size("ioc_urls").cast("string"), F.lit(" domainCount="),
        F.size("domains").cast("string"), F.lit(" rawEmailHash="), F.col("raw_email_hash"), F.lit(" verdict="), F.col("verdict")).alias("line"))


def text_summary(arrays: DataFrame, timestamp: str, cap: int | None = None) -> DataFrame:
    """``mail_id, report``: plain-text indicator report; needs ``prob`` (NULL or negative: not available)."""
    rule, thin = "═" * 60, "  " + "─" * 40

    def section(title: str, column: str) -> Column:
        items = F.col(column)
        shown = F.transform(rows.first(items, cap), lambda v: F.concat(F.lit("    "), v))
        more = F.array().cast("array<string>")
        if cap is not None:
            more = F.when(F.size(items) > cap, F.array(F.concat(F.lit("    ... and "), (F.size(items) - cap).cast("string"), F.lit(" more")))).otherwise(more)
        lines = F.when(F.size(items) == 0, F.array(F.lit("    (none)"))).otherwise(F.concat(shown, more))
        head = F.concat(F.lit(f"\n  {title}  ("), F.size(items).cast("string"), F.lit(" found)"))
        return F.array_join(F.concat(F.array(head, F.lit(thin)), lines), "\n")

    score = F.when(F.col("prob") >= 0, X.percent(F.col("prob"), 1)).otherwise(F.lit("N/A"))
    return arrays.select("mail_id", F.concat_ws(
        "\n", F.lit(rule), F.lit("  Indicator report"), F.lit(f"  Generated : {timestamp}"), F.concat(F.lit("  Risk Score: "), score), F.lit(rule),
        section("Sender Email Addresses", "sender_emails"), section("Sender IPs", "sender_ips"), section("URLs", "ioc_urls"),
        section("Domains", "domains"), F.concat(F.lit("\n  Raw Email SHA-256: "), F.col("raw_email_hash")), F.lit(rule)).alias("report"))


def technique_report(df: DataFrame) -> DataFrame:
    """``mail_id, report``: text report of ``techniques`` with a bar per confidence."""
    def block(t: Column) -> Column:
        url = F.concat(F.lit(L.TECHNIQUE_URL), F.replace(t["technique_id"], F.lit("."), F.lit("/")), F.lit("/"))
        bar = F.repeat(F.lit("█"), F.floor(t["confidence"] * 10).cast("int"))
        return F.concat(F.lit("\n["), t["technique_id"], F.lit("] "), t["technique_name"], F.lit("\n  Tactic:     "), t["tactic"],
                        F.lit("\n  Confidence: "), bar, F.lit(" "), X.percent(t["confidence"]), F.lit("\n  Evidence:   "), F.array_join(t["evidence"], ", "),
                        F.lit("\n  Reference:  "), url)

    body = F.concat(F.lit("MITRE ATT&CK Technique Mapping\n" + "=" * 40 + "\n"), F.array_join(F.transform("techniques", block), "\n"))
    none = F.lit("No ATT&CK techniques mapped (email classified as legitimate).")
    return df.select("mail_id", F.when(F.size("techniques") == 0, none).otherwise(body).alias("report"))


def analysis_report(df: DataFrame) -> DataFrame:
    """``mail_id, report``: JSON of verdict, metadata, indicators and techniques of each mail."""
    meta = F.struct(F.col("from_address").alias("from"), "subject", F.size("attachment_hashes").alias("attachments"), F.size("ioc_urls").alias("url_count"),
                    F.col("hdr_spf_result").alias("spf"), F.col("hdr_dkim_result").alias("dkim"), F.col("hdr_dmarc_result").alias("dmarc"))
    iocs = F.struct("sender_emails", "sender_ips", F.col("ioc_urls").alias("urls"), "cleaned_urls", "domains", "attachment_hashes", "raw_email_hash")
    body = F.struct("source", "verdict", F.col("prob").alias("phishing_probability"), meta.alias("email_metadata"), iocs.alias("iocs"),
                    F.col("techniques").alias("attack_techniques"))
    return df.select("mail_id", F.to_json(body).alias("report"))


def write_split(df: DataFrame, path: str) -> None:
    """Training and test part as Parquet folders ``split=train`` and ``split=test``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Small result tables (metrics, manifest) as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One text line (or block) per row."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
