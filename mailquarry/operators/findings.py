"""Analyst findings from header, address, link and HTML columns, as arrays of structs in the row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import net
from mailquarry.functions import rows as R
from mailquarry.functions import text as X
from mailquarry.operators.urls import official_site


def severity_rank(c: Column) -> Column:
    out = F.lit(0)
    for rank, name in enumerate(L.SEVERITIES):
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def _findings(rows: Iterable[tuple[Column, str, Column | str, Column | str]]) -> Column:
    """Array of ``severity, title, detail`` for the rows whose condition holds, in order."""
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(sev).alias("severity"), as_col(title).alias("title"), as_col(detail).alias("detail")))
        for cond, sev, title, detail in rows]))


def header_findings() -> Column:
    """Findings from the ``hdr_*`` columns; details name the fields involved."""
    c = F.col
    domain = F.lower(F.regexp_extract("from_address", r"@([a-zA-Z0-9_.\-]+)", 1))
    spf, dkim, dmarc = c("hdr_spf_result"), c("hdr_dkim_result"), c("hdr_dmarc_result")
    pair = lambda other: F.concat(F.lit("from="), c("from_address"), F.lit("; other="), c(other))
    hops = c("hdr_received_hop_count")
    return _findings([
        (spf < 0, "HIGH", "SPF Authentication FAILED", domain),
        (spf == 0, "MEDIUM", "SPF Neutral / No SPF Policy", domain),
        (spf > 0, "INFO", "SPF Authentication Passed", domain),
        (dkim < 0, "HIGH", "DKIM Signature Invalid / Missing", domain),
        (dkim == 0, "MEDIUM", "DKIM Signature Not Verified", domain),
        (dkim > 0, "INFO", "DKIM Signature Valid", domain),
        (dmarc < 0, "CRITICAL", "DMARC Policy VIOLATED", domain),
        (dmarc == 0, "LOW", "DMARC: Monitor-Only Policy (p=none)", domain),
        (c("hdr_from_reply_to_mismatch") == 1, "HIGH", "From ≠ Reply-To Domain Mismatch", pair("reply_to")),
        (c("hdr_from_return_path_mismatch") == 1, "MEDIUM", "From ≠ Return-Path Domain Mismatch", pair("return_path")),
        (c("hdr_reply_to_freemail") == 1, "MEDIUM", "Reply-To Uses Free Email Provider", c("reply_to")),
        (hops > 6, "MEDIUM", F.concat(F.lit("Excessive Relay Chain ("), hops.cast("string"), F.lit(" hops)")), hops.cast("string")),
        (c("hdr_received_geo_anomaly") == 1, "MEDIUM", "Geographic Origin Anomaly", hops.cast("string")),
        (c("hdr_x_mailer_suspicious") == 1, "LOW", "Suspicious X-Mailer / Sending Tool", c("x_mailer")),
    ])


def with_address_findings(df: DataFrame) -> DataFrame:
    """Add ``address_findings``: free mail, display-name brand, brand in a sub-domain, foreign Return-Path."""
    pattern = r"([a-zA-Z0-9_.%+\-]+)@([a-zA-Z0-9_.\-]+)"
    shown = F.regexp_replace(X.strip(F.regexp_extract("from_address", r"^(.+?)\s*<", 1)), '^"+|"+$', "")
    stages = [
        lambda g: {"_domain": F.lower(F.regexp_extract(g("from_address"), pattern, 2)),
                   "_back": F.lower(F.regexp_extract(g("return_path"), pattern, 2)), "_shown": F.lower(shown)},
        lambda g: {"_first": F.substring_index(g("_domain"), ".", 1), "_root": F.substring_index(g("_domain"), ".", -2)},
        lambda g: {"_brand": X.first_present(g("_shown"), L.BRAND_OFFICIAL), "_sub": X.first_present(g("_first"), L.BRAND_OFFICIAL)},
        lambda g: {"_site": official_site(g("_brand"))},
    ]
    domain, back, brand, sub = (F.col(c) for c in ("_domain", "_back", "_brand", "_sub"))
    genuine = F.endswith(domain, F.col("_site"))
    has = domain != ""
    found = _findings([
        (has & domain.isin(L.FREEMAIL_FINDINGS), "MEDIUM", "From: free mail", domain),
        (has & brand.isNotNull() & ~genuine, "CRITICAL", "From: display name", F.concat_ws("|", brand, domain)),
        (has & brand.isNotNull() & genuine, "INFO", "From: official domain", F.concat_ws("|", brand, domain)),
        (domain.rlike(r"\..*\.") & sub.isNotNull() & ~X.contains_any(F.col("_root"), L.BRAND_OFFICIAL), "HIGH",
         "From: brand in sub-domain", F.concat_ws("|", sub, domain)),
        ((back != "") & has & (back != domain), "MEDIUM", "Return-Path: other domain", back),
    ])
    return net.run_stages(df, stages).select(*df.columns, found.alias("address_findings"))


def html_findings() -> Column:
    c = F.col
    hidden, b64, scripts = c("html_hidden_text_count"), c("html_base64_content_count"), c("html_javascript_count")
    share, links = c("html_link_domain_diversity"), c("html_total_links")
    title = lambda a, n, b: F.concat(F.lit(a), n.cast("string"), F.lit(b))
    return _findings([
        (c("html_external_form_action") > 0, "CRITICAL", "External Form Action — Direct Credential Harvester", "form"),
        (hidden > 0, "HIGH", title("Hidden Text Elements (", hidden, " found) — Filter Evasion"), "hidden"),
        (b64 > 0, "HIGH", title("Base64-Encoded Content (", b64, " instances) — Obfuscation"), "base64"),
        (scripts > 2, "MEDIUM", title("JavaScript in Email Body (", scripts, " script blocks)"), "script"),
        ((share > 0.75) & (links > 5), "MEDIUM", F.concat(
            F.lit("High Link Domain Diversity ("), X.percent(share), F.lit(" across "), links.cast("string"), F.lit(" links)")), "links"),
    ])


def _any_at_least(findings: str, rank: int) -> Column:
    return F.exists(findings, lambda f: severity_rank(f["severity"]) >= rank)


def summary_findings(width: int | None = None) -> Column:
    """Headline codes from ``header_findings``, ``triage``, ``address_findings``, ``html_findings`` and urgency; ``width`` cuts the link shown."""
    titled = lambda word: F.exists("html_findings", lambda f: F.contains(F.lower(f["title"]), F.lit(word)))
    bad = F.filter("triage", lambda t: t["severity_rank"] >= 3)
    urgency = F.col("txt_urgency_score_normalised")
    link = F.get(bad, F.lit(0))["url"]
    link = link if width is None else F.substring(link, 1, width)
    return F.array_compact(F.array(
        F.when(_any_at_least("header_findings", 4), F.lit("authentication failed")),
        F.when(F.size(bad) > 0, F.concat(F.lit("high-risk link: "), link)),
        F.when(_any_at_least("address_findings", 4), F.lit("sender poses as a brand")),
        F.when(titled("credential") | titled("form"), F.lit("credential form")),
        F.when(titled("hidden"), F.lit("hidden text")),
        F.when(urgency > 0.4, F.concat(F.lit("urgent language: "), X.percent(urgency)))))


def finding_rows(df: DataFrame, column: str, area: str) -> DataFrame:
    """Long table ``mail_id, area, pos, severity, title, detail`` of one findings column."""
    return (R.explode_with_pos(df, ["mail_id", F.lit(area).alias("area")], column, "pos", "f")
            .select("mail_id", "area", "pos", "f.severity", "f.title", "f.detail"))
