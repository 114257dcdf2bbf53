"""Indicators of compromise: addresses, IPs, links, domains and hashes of a mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.functions import net, rows
from mailquarry.functions import text as X
from mailquarry.operators import mime, unwrap
from mailquarry.operators.mail import body_choice


def _sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def addresses() -> Column:
    """Sender addresses from From, Reply-To and Return-Path."""
    found = [F.regexp_extract_all(c, F.lit(net.ADDRESS), F.lit(0)) for c in ("from_address", "reply_to", "return_path")]
    return _sorted_set(F.concat(*found))


def ips() -> Column:
    """Public addresses of the relay chain and of X-Originating-IP."""
    found = F.concat(F.flatten(F.transform("received", net.ips_in)), net.ips_in(F.col("x_originating_ip")))
    return _sorted_set(F.filter(found, lambda ip: ~net.is_private_ip(ip)))


def links() -> Column:
    """Links of the mail plus those of the refanged body."""
    body = F.regexp_extract_all(X.refang(body_choice()), F.lit(net.URL_IN_BODY), F.lit(0))
    both = F.transform(F.concat("urls", body), lambda u: F.regexp_replace(u, r"""[.,;)'"]+$""", ""))
    return _sorted_set(F.filter(both, lambda u: u != ""))


def hashes_and_files(text: Column) -> dict[str, Column]:
    """MD5, SHA-1, SHA-256 and names of executable files in a text."""
    hexed = lambda n: F.regexp_extract_all(text, F.lit(rf"\b[a-fA-F0-9]{{{n}}}\b"), F.lit(0))
    names = r"(?i)\b\S+\.(?:exe|vbs|bat|cmd|ps1|lnk|iso|img|msi|scr|jar|wsf|hta|vbe|jse)\b"
    return {"md5": hexed(32), "sha1": hexed(40), "sha256": hexed(64),
            "file": F.regexp_extract_all(text, F.lit(names), F.lit(0))}


def indicator_arrays(mail: DataFrame, keep: tuple[str, ...] = ("mail_id",)) -> DataFrame:
    """All indicators of a mail as sorted arrays in its row; no shuffle.

    ``cleaning`` holds ``url, current, method, was_wrapped`` per link; domains come from the unwrapped links.
    """
    step = mail.select(*keep, addresses().alias("sender_emails"), ips().alias("sender_ips"), links().alias("ioc_urls"),
                       F.transform("attachments", lambda a: F.nullif(a["sha256"], F.lit(mime.EMPTY_SHA256))).alias("attachment_hashes"),
                       F.sha2(F.col("raw_email"), 256).alias("raw_email_hash"))
    step = step.withColumn("cleaning", unwrap.cleaned_in_array(F.col("ioc_urls")))
    cleaned = _sorted_set(F.transform("cleaning", lambda s: s["current"]))
    domains = F.transform(cleaned, lambda u: F.regexp_replace(F.lower(net.netloc(u)), r"^www\.", ""))
    return step.withColumn("cleaned_urls", cleaned).withColumn("domains", _sorted_set(F.filter(domains, lambda d: d != "")))


def indicator_rows(arrays: DataFrame) -> DataFrame:
    """Long table ``mail_id, ioc_type, value, cleaned, method, was_wrapped``."""
    def plain(kind: str, column: str) -> Column:
        return F.transform(F.filter(column, lambda v: v.isNotNull()), lambda v: F.struct(
            F.lit(kind).alias("ioc_type"), v.alias("value"), v.alias("cleaned"), F.lit("none").alias("method"), F.lit(False).alias("was_wrapped")))

    wrapped = F.transform("cleaning", lambda s: F.struct(
        F.lit("url").alias("ioc_type"), s["url"].alias("value"), s["current"].alias("cleaned"), s["method"].alias("method"), s["was_wrapped"].alias("was_wrapped")))
    everything = F.concat(plain("email", "sender_emails"), plain("ip", "sender_ips"), wrapped,
                          plain("domain", "domains"), plain("hash", "attachment_hashes"))
    return rows.explode_structs(arrays, ["mail_id"], everything, "ioc_type")


def prevalence(iocs: DataFrame, scores: DataFrame) -> DataFrame:
    """Campaign view: mails per indicator with the range of their scores.

    A value occurs once per mail and type, so a plain count is the number of mails and a popular
    indicator is combined before the shuffle.
    """
    return (iocs.select("mail_id", "ioc_type", "value").join(scores.select("mail_id", "score"), "mail_id")
            .groupBy("ioc_type", "value")
            .agg(F.count("*").alias("n_mails"), F.min("score").alias("min_score"), F.max("score").alias("max_score")))
