"""Raw mail text to header, body and link columns.

Everything here is a projection over one row: no shuffle. Mails that expressions cannot decode are a branch of their
own (:mod:`mailquarry.operators.mime`), the only part that uses Python workers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry.functions import net, rows, tags
from mailquarry.functions import text as X
from mailquarry.operators import mime

# column -> header name
FIELDS = {
    "from_address": "from", "to_address": "to", "reply_to": "reply-to", "return_path": "return-path",
    "subject": "subject", "date": "date", "message_id": "message-id", "x_mailer": "x-mailer",
    "content_type": "content-type", "auth_results": "authentication-results",
    "received_spf_header": "received-spf", "list_unsubscribe": "list-unsubscribe",
    "x_priority": "x-priority", "x_originating_ip": "x-originating-ip", "user_agent": "user-agent",
    "x_spam_status": "x-spam-status", "mime_version": "mime-version",
    "content_transfer_encoding": "content-transfer-encoding",
}
FREE_TEXT = ["from_address", "to_address", "reply_to", "return_path", "subject", "x_mailer", "user_agent", "list_unsubscribe"]

_HEADER_LINE = r"^(?:[!-9;-~]*:|[ \t]|From )"


def split_head(df: DataFrame, raw: str = "raw_email") -> DataFrame:
    """Add ``head`` (unfolded header lines, one per line) and ``body`` (everything after).

    Headers end at the first blank line, or earlier at the first line that cannot be a header, so a
    corpus row without headers is all body.
    """
    parts = df.withColumn("_parts", mime.halves(F.col(raw)))
    parts = parts.withColumn("_lines", F.split(F.col("_parts")[0], "\r?\n"))
    first_bad = F.array_position(F.transform("_lines", lambda l: l.rlike(_HEADER_LINE)), F.lit(False))
    parts = parts.withColumn("_bad", first_bad.cast("int"))
    head_lines = F.when(F.col("_bad") == 0, F.col("_lines")).otherwise(
        F.slice("_lines", F.lit(1), F.col("_bad") - 1))
    rest = F.coalesce(F.get("_parts", F.lit(1)), F.lit(""))
    early = F.concat(F.array_join(F.slice("_lines", F.greatest(F.col("_bad"), F.lit(1)), F.size("_lines")), "\n"),
                     F.when(F.size("_parts") > 1, F.concat(F.lit("\n\n"), F.col("_parts")[1])).otherwise(F.lit("")))
    keep = [c for c in df.columns]
    return parts.select(
        *keep,
        F.regexp_replace(F.array_join(head_lines, "\n"), r"\n[ \t]+", " ").alias("head"),
        F.when(F.col("_bad") == 0, rest).otherwise(F.regexp_replace(early, "^\n", "")).alias("body"))


def header_value(head: Column, name: str) -> Column:
    """First value of a header, '' when absent."""
    return X.strip(F.regexp_extract(head, rf"(?i)(?:^|\n){name}:[ \t]*([^\n]*)", 1))


def header_values(head: Column, name: str) -> Column:
    return F.regexp_extract_all(head, F.lit(rf"(?i)(?:^|\n){name}:[ \t]*([^\n]*)"), F.lit(1))


def decode_words(c: Column) -> Column:
    """Decode RFC 2047 encoded words in UTF-8 and in all character sets of one byte; others stay as they are."""
    word = r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?="
    joined = F.regexp_replace(c, r"(\?=)[ \t]+(=\?)", "$1$2")

    def decoded(w: Column) -> Column:
        kind, data = F.lower(F.regexp_extract(w, word, 2)), F.regexp_extract(w, word, 3)
        raw = F.when(kind == "b", mime.base64_bytes(data)).otherwise(mime.quoted_bytes(F.replace(data, F.lit("_"), F.lit(" "))))
        return F.coalesce(mime.text_of(raw, F.lower(F.regexp_extract(w, word, 1))), w)

    found = F.regexp_extract_all(joined, F.lit(word), F.lit(0))
    out = F.aggregate(found, joined, lambda acc, w: F.replace(acc, w, decoded(w)))
    return F.when(F.contains(c, F.lit("=?")), out).otherwise(c)


def header_rows(df: DataFrame) -> DataFrame:
    """Child table ``mail_id, pos, name, value`` of all header lines, names in lower case."""
    lines = rows.explode_with_pos(split_head(df.select("mail_id", "raw_email")), ["mail_id"], F.split("head", "\n"), "pos", "line")
    return (lines.where(F.contains("line", F.lit(":")))
            .select("mail_id", "pos",
                    F.lower(F.substring_index("line", ":", 1)).alias("name"),
                    X.strip(F.regexp_replace("line", "^[^:]*:", "")).alias("value")))


def with_fields(df: DataFrame, dump: int | None = None, any_charset: bool = False) -> DataFrame:
    """Named header fields, the relay chain and the header dump (its first ``dump`` characters if given), from ``head``.

    The head is read once, into names and values. ``any_charset`` decodes encoded words of all
    character sets, in Python workers.
    """
    lines = F.filter(F.split("head", "\n"), lambda l: F.contains(l, F.lit(":")))
    names = F.transform(lines, lambda l: F.lower(F.substring_index(l, ":", 1)))
    values = F.transform(lines, lambda l: X.strip(F.substr(l, F.length(F.substring_index(l, ":", 1)) + 2)))
    read = df.withColumn("_names", names).withColumn("_values", values)
    value = lambda name: F.coalesce(F.get("_values", F.array_position("_names", F.lit(name)).cast("int") - 1), F.lit(""))          # the first of several
    found = {col: value(name) for col, name in FIELDS.items()}
    found["x_priority"] = F.coalesce(F.nullif(found["x_priority"], F.lit("")), value("priority"))
    others = [c for c in df.columns if c != "head"]
    raw = read.select(
        *others, *[v.alias(n) for n, v in found.items()], F.array_contains("_names", "dkim-signature").cast("int").alias("dkim_signed"),
        F.filter("_values", lambda _, i: F.get("_names", i) == "received").alias("received"),
        (F.col("head") if dump is None else F.substring("head", 1, dump)).alias("header_raw"))
    # Encoded words occur in free text only. One lambda decodes these fields, in a projection of its own.
    coded = F.array(*[F.col(n) for n in FREE_TEXT])
    raw = raw.withColumn("_text", mime.decoded_headers(coded) if any_charset else F.transform(coded, decode_words))
    return raw.select(*[F.col("_text")[FREE_TEXT.index(c)].alias(c) if c in FREE_TEXT else F.col(c) for c in raw.columns if c != "_text"])


def links(text: Column, html: Column) -> Column:
    """Ordered distinct links: from text, from HTML source, from a[href], then from img/iframe[src]."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(tags.ANCHOR), F.lit(0)), lambda t: X.strip(tags.attribute(t, "href")))
    srcs = F.transform(F.regexp_extract_all(html, F.lit(tags.SOURCE), F.lit(0)),
                       lambda t: X.strip(tags.attribute(t, "src")))
    absolute = F.filter(F.concat(hrefs, srcs), lambda u: u.rlike("^(?i)https?://"))
    found = F.concat(F.regexp_extract_all(text, F.lit(net.URL_IN_TEXT), F.lit(0)),
                     F.regexp_extract_all(html, F.lit(net.URL_IN_TEXT), F.lit(0)), absolute)
    trimmed = F.transform(found, lambda u: F.regexp_replace(u, r"""[.,;)'"]+$""", ""))
    return F.array_distinct(F.filter(trimmed, lambda u: u != ""))


def needs_mime() -> Column:
    return (F.lower("content_type").rlike("^multipart/|charset\\s*=\\s*\"?(?!utf-?8|us-ascii)[a-z]")
            | F.lower("content_transfer_encoding").rlike("base64|quoted-printable"))


def _with_bodies(fields: DataFrame, parts: Column | None, broken_parts: bool = False) -> DataFrame:
    """Bodies, attachments and links; ``parts`` is NULL for mails that are one undecoded part."""
    others = [c for c in fields.columns if c not in ("body", "_head", "_parts")]
    if broken_parts:
        lost = F.transform(F.filter("_parts", lambda p: p["failed"]), lambda p: F.struct(p["part_no"].alias("part_no"), p["mime"].alias("mime")))
        fields = fields.withColumn("_parts", parts).withColumn("broken_parts", lost)
        return _with_bodies(fields, F.col("_parts"))
    is_html = F.contains(F.lower("content_type"), F.lit("html"))
    none = F.array().cast("array<struct<filename:string,sha256:string>>")
    plain = [F.when(is_html, F.lit("")).otherwise(F.col("body")), F.when(is_html, F.col("body")).otherwise(F.lit("")), none]
    if parts is not None:
        fields = fields.withColumn("_parts", parts)
        simple = F.col("_parts").isNull()
        plain = [F.when(simple, p).otherwise(d) for p, d in zip(plain, mime.body_columns(F.col("_parts")), strict=True)]
    out = fields.select(*others, *[c.alias(n) for c, n in zip(plain, ("body_text", "body_html", "attachments"), strict=True)])
    return out.select(*others, "body_text", "body_html", links(F.col("body_text"), F.col("body_html")).alias("urls"), "attachments")


def parse_mail(df: DataFrame, mime_parts: bool = True, broken_parts: bool = False) -> DataFrame:
    """One row per mail with header fields, bodies, links and attachments.

    Input: ``mail_id, raw_email`` and any other columns, which are kept. With ``mime_parts=False`` the caller
    states that no mail has parts or encoded content (body-only corpora).
    Mails that only Python can decode (``mime.unusual``) are a branch of their own; all others stay in the JVM.
    """
    if not mime_parts:
        return _with_bodies(with_fields(split_head(df)), None)
    marked = rows.with_fixed(df, "_odd", mime.unusual(F.col("raw_email")))
    usual = with_fields(split_head(marked.where("NOT _odd").drop("_odd")).withColumn("_head", F.col("head")))
    hard = F.coalesce(needs_mime(), F.lit(False))
    usual = _with_bodies(usual, F.when(hard, mime.native_parts(F.col("_head"), F.col("body"))), broken_parts)
    rest = _with_bodies(with_fields(split_head(marked.where("_odd").drop("_odd")), any_charset=True), mime.decoded_parts("raw_email"), broken_parts)
    return usual.unionByName(rest)


def body_choice() -> Column:
    """Text part, else HTML part, else ''."""
    return F.coalesce(F.nullif("body_text", F.lit("")), F.nullif("body_html", F.lit("")), F.lit(""))


def mail_fields(df: DataFrame) -> DataFrame:
    return with_fields(split_head(df))


def link_rows(mail: DataFrame) -> DataFrame:
    """Child table ``mail_id, pos, url``; positions start at 0."""
    return rows.explode_with_pos(mail, ["mail_id"], "urls", "pos", "url")


def relay_chain(mail: DataFrame) -> DataFrame:
    """Child table ``mail_id, pos, received``, newest relay first."""
    return rows.explode_with_pos(mail, ["mail_id"], "received", "pos", "received")


def sender_ip(received: Column, prefixes: Iterable[str] = ("10.", "192.168.", "127.", "0.0.0.0")) -> Column:
    """First public address of the relay header nearest to the origin that has one; NULL if none."""
    public = F.flatten(F.transform(F.reverse(received), lambda h: F.filter(
        net.ips_in(h), lambda ip: ~net.is_private_ip(ip, prefixes))))
    return F.get(public, F.lit(0))
