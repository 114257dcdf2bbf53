"""HTML structure features from a tag scan; one projection per row, no parser, no shuffle.

Comments and the contents of script and style blocks are removed first, in one scan that takes tags with their quoted
values as units. An unclosed tag is read as written.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import net, tags
from mailquarry.functions import text as X
from mailquarry.functions.tags import attribute, without_hidden, without_tags

_DOMAIN_TEXT = r"[a-zA-Z0-9_\-]+\.[a-zA-Z]{2,}"


def visible_text(clean: Column) -> Column:
    return F.regexp_replace(without_tags(clean), r"&nbsp;|&#160;", " ")


def _is(tag: Column, *names: str) -> Column:
    return tag.rlike(rf"(?i)^<(?:{'|'.join(names)})\b")


def _has(tag: Column, name: str) -> Column:
    bare = F.regexp_replace(tag, r""""[^"]*"|'[^']*'""", '""')
    return bare.rlike(rf"""(?i)[\s"'/]{name}(?:[\s=/]|>)""")


def _count(found: Column, condition) -> Column:
    return F.size(F.filter(found, condition))


def is_mismatch(anchor: Column) -> Column:
    """Does an anchor show one domain and lead to another?"""
    href = X.strip(attribute(F.regexp_extract(anchor, tags.ANCHOR, 0), "href"))
    shown = X.strip(without_tags(anchor))
    usable = href.rlike("^https?://") & (shown != "")
    ip_link = href.rlike(rf"^https?://{net.IPV4}") & shown.rlike(r"[a-zA-Z]{3,}\.[a-zA-Z]{2,}")
    to = F.regexp_replace(F.lower(net.netloc(href)), r"^www\.", "")
    claims = F.regexp_replace(F.lower(F.regexp_extract(shown, _DOMAIN_TEXT, 0)), r"^www\.", "")
    other = shown.rlike(r"[a-zA-Z0-9][.\-][a-zA-Z]{2,}") & (to != "") & (claims != "") & (to != claims)
    return usable & (ip_link | other)


def meta_refresh(found: Column) -> Column:
    """1 if a meta tag sends the reader on after a delay."""
    return F.exists(found, lambda t: _is(t, "meta") & (F.lower(attribute(t, "http-equiv")) == "refresh")
                    & F.contains(F.lower(attribute(t, "content")), F.lit("url="))).cast("int")


def with_tags(df: DataFrame, html: str) -> DataFrame:
    """Add ``_clean`` and ``_tags``, each computed once."""
    df = df.withColumn("_clean", without_hidden(F.col(html)))
    return df.withColumn("_tags", F.regexp_extract_all("_clean", F.lit(tags.OPEN), F.lit(0)))


def html_features(df: DataFrame, html: str = "body_html", suffixes: Iterable[str] | None = None,
                  keep: Iterable[str] = ("mail_id",), max_chars: int | None = None) -> DataFrame:
    """``html_*`` columns. ``max_chars`` optionally bounds the text that is scanned."""
    if max_chars is not None:
        df = df.withColumn(html, F.substring(html, 1, max_chars))
    found = F.col("_tags")
    hidden = "(?i)" + "|".join(f"(?:{p})" for p in L.HIDDEN_STYLES)
    pixel = lambda t: ((attribute(t, "width") == "1") & (attribute(t, "height") == "1")) | F.contains(F.lower(attribute(t, "src")), F.lit("tracking"))
    sheet = lambda t: (_is(t, "link") & F.contains(F.lower(attribute(t, "rel")), F.lit("stylesheet"))
                       & F.startswith(attribute(t, "href"), F.lit("http")))
    hrefs = F.transform(F.filter(found, lambda t: _is(t, "a") & _has(t, "href")), lambda t: attribute(t, "href"))
    staged = with_tags(df, html).select(
        *keep, "_clean", "_tags",
        F.regexp_extract_all("_clean", F.lit(tags.LINKED), F.lit(0)).alias("_anchors"),
        hrefs.alias("_hrefs"),
        X.word_count(visible_text(F.col("_clean"))).alias("_words"),
        _count(found, lambda t: _is(t, "img")).alias("_images"))
    hosts = net.run_stages_in_array(F.filter("_hrefs", lambda h: F.startswith(h, F.lit("http"))), "url", net.domain_stages("url", suffixes))
    domains = F.array_distinct(F.filter(F.transform(hosts, lambda s: s["domain"]), lambda d: d != ""))
    staged = staged.withColumn("_domains", F.size(domains)).withColumn("_links", F.size("_hrefs"))
    cols = {
        "href_text_mismatch_count": _count(F.col("_anchors"), is_mismatch),
        "external_form_action": F.exists(found, lambda t: _is(t, "form") & attribute(t, "action").rlike("^https?://")).cast("int"),
        "hidden_text_count": _count(found, lambda t: attribute(t, "style").rlike(hidden)) + _count(found, lambda t: _has(t, "hidden")),
        "image_to_text_ratio": F.when(F.col("_words") == 0, F.col("_images").cast("double")).otherwise(F.col("_images") / F.col("_words")),
        "tracking_pixel_count": _count(found, lambda t: _is(t, "img") & pixel(t)),
        "base64_content_count": F.regexp_count("_clean", F.lit(r"(?i)data:[^;]+;base64,")),
        "javascript_count": _count(found, lambda t: _is(t, "script")),
        "external_css_count": _count(found, sheet),
        "total_links": F.col("_links"),
        "unique_domains_in_links": F.col("_domains"),
        "link_domain_diversity": F.when(F.col("_links") == 0, F.lit(0.0)).otherwise(F.col("_domains") / F.col("_links")),
    }
    return staged.select(*keep, *[cols[n].alias(f"html_{n}") for n in L.HTML_FEATURES])
