"""MIME parts as column expressions, and a way out for mails that expressions can't decode.

A mail is split at its boundary, and each part's headers, transfer encoding and character set are read by functions of
arrays and binaries, so the common case never leaves the JVM. Character sets of one byte are decoded as Latin-1, whose upper half
is then exchanged for that of the set. Mails with nested parts, character sets of several bytes, encoded file names or
unknown encodings are told by their raw text (``unusual``); only these go to Python workers, in a branch of their own.
No part is lost: one that cannot be decoded is kept with ``failed`` set and no content (``failed_parts`` lists them).
"""

from __future__ import annotations

import email
import email.header
import email.policy
import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mailquarry.functions import rows

PART = (T.StructType().add("part_no", "integer").add("mime", "string").add("is_attachment", "boolean").add("filename", "string")
        .add("content", "string").add("payload", "binary").add("failed", "boolean"))
_ARROW = to_arrow_type(T.ArrayType(PART))
UTF8 = ("utf-8", "utf8", "")
ONE_BYTE = ("us-ascii", "ascii", "latin-1", "latin1", *(f"iso-8859-{k}" for k in (1, 2, 3, 4, 5, 7, 9, 10, 13, 14, 15, 16)), *(f"windows-125{k}" for k in range(9)),
            *(f"cp125{k}" for k in range(9)), "koi8-r", "koi8-u")
_ALL = 1 << 30        # elements of a slice to the end
_UPPER_HALF = "".join(map(chr, range(128, 256)))
_KNOWN = "|".join(re.escape(c) for c in (*UTF8, *ONE_BYTE) if c)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_UNUSUAL_LINE = (r"(?im)^content-t(?:ype:\s*message/|ransfer-encoding:[ \t]*(?!7bit|8bit|binary|base64|quoted-printable)\S"
                 r"|(?s:ype:\s*multipart/.*^content-type:\s*multipart/))")
_UNUSUAL_CHARSET = rf"(?i)charset\s*=\s*[\"']?(?!(?:{_KNOWN})(?:[\"'\s;>]|$))[\w]"
_UNUSUAL_NAME = r"(?i)name(?:\*\d*\*?=|\s*=\s*[\"']?=\?)"
_RETURN = re.compile(r"\r(?=\n--[^\r\n]*\n)")
_UNUSUAL_WORD = rf"(?i)=\?(?!(?:{_KNOWN})\?)[^?\s]+\?[bq]\?"


def unusual(raw: Column) -> Column:
    """Whether a mail may need more than the expressions below; a text that only looks like it is decoded all the same."""
    # A pattern starts with fixed text, as alternatives are tried at every character.
    word, typed = F.contains(raw, F.lit("=?")), raw.rlike("(?i)content-t")
    return F.coalesce((word | typed) & ((typed & raw.rlike(_UNUSUAL_LINE)) | raw.rlike(_UNUSUAL_CHARSET) | raw.rlike(_UNUSUAL_NAME) | (word & raw.rlike(_UNUSUAL_WORD))), F.lit(False))


# --- bytes and texts ----------------------------------------------------------------------

@cache
def _upper_halves() -> dict[str, str]:
    return {c: bytes(range(128, 256)).decode(c, "replace") for c in ONE_BYTE}


def text_of(data: Column, charset: Column) -> Column:
    """Bytes as text; what the set does not have becomes a replacement character. NULL for sets that are not known here."""
    halves = F.str_to_map(F.lit("\2".join(f"{k}\1{v}" for k, v in _upper_halves().items())), F.lit("\2"), F.lit("\1"))        # one literal
    one_byte = F.call_function("translate", F.decode(data, "ISO-8859-1"), F.lit(_UPPER_HALF), F.try_element_at(halves, charset))
    return F.when(charset.isin(*UTF8), F.make_valid_utf8(data.cast("string"))).otherwise(one_byte)


def quoted_bytes(text: Column) -> Column:
    """Bytes of quoted-printable text; an equals sign that starts no code stays."""
    soft = F.split(F.regexp_replace(text, "=[ \t]*\r?\n", ""), "=")
    code = lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.substring(p, 1, 2), F.hex(F.substr(p, F.lit(3))))).otherwise(F.concat(F.lit("3D"), F.hex(p)))
    rest = lambda s: F.array_join(F.transform(F.slice(s, 2, _ALL), code), "")
    return rows.once(soft, lambda s: F.unhex(F.concat(F.hex(s[0]), rest(s))))


def base64_bytes(text: Column) -> Column:
    """Bytes of base64 text up to its padding, stray characters left out; NULL if it can't be read."""
    lines = F.replace(F.replace(F.substring_index(text, "=", 1), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    bare = lambda t: F.when(t.rlike(r"[^\w+/]") | F.contains(t, F.lit("_")), F.regexp_replace(t, "[^A-Za-z0-9+/]", "")).otherwise(t)
    whole = lambda t: F.when(F.length(t) % 4 == 1, F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    padded = lambda t: F.concat(t, F.repeat(F.lit("="), F.pmod(-F.length(t), F.lit(4))))
    return rows.once(lines, lambda t: rows.once(bare(t), lambda t: rows.once(whole(t), lambda t: F.try_to_binary(padded(t), F.lit("base64")))))


def _bytes(encoding: Column, body: Column) -> Column:
    return (F.when(encoding == "base64", base64_bytes(body)).when(encoding == "quoted-printable", quoted_bytes(body)).otherwise(F.encode(body, "UTF-8")))


# --- parts --------------------------------------------------------------------------------

def _value(head: Column, name: str) -> Column:
    return F.btrim(F.regexp_extract(head, rf"(?i)(?:^|\n){name}:[ \t]*([^\n]*)", 1))


def _parameter(value: Column, name: str) -> Column:
    """A parameter of a structured header, without its quotes; '' when absent."""
    pattern = rf"""(?i)(?:^|[;\s]){name}\s*=\s*(?:"([^"]*)"|([^\s;"]+))"""
    return F.concat(F.regexp_extract(value, pattern, 1), F.regexp_extract(value, pattern, 2))


def halves(text: Column) -> Column:
    """What is before and after the first blank line, as an array; the whole text alone if there is none. A split by pattern would search on to the end."""
    def cut(head: Column) -> Column:
        both = F.array(F.regexp_replace(head, r"\r?\n\r?\n\z", ""), F.substr(text, F.length(head) + 1))
        return F.when(head == "", F.array(text)).when(head.isNotNull(), both)

    return rows.once(F.regexp_extract(text, r"(?s)^.*?\r?\n\r?\n", 0), cut)


def _split(piece: Column) -> Column:
    """Head and body of a part, as an array; a part that starts with a blank line or with no header has no head."""
    headed = piece.rlike(r"^[!-9;-~]+:")
    bare = F.array(F.lit(""), F.regexp_replace(piece, r"^\r?\n", ""))
    parts = lambda cut: F.array(F.regexp_replace(F.regexp_replace(cut[0], r"\r?\n[ \t]+", " "), r"\r\n", "\n"), F.coalesce(F.get(cut, F.lit(1)), F.lit("")))
    return F.when(headed, rows.once(halves(piece), parts)).otherwise(bare)


def _fields(part: Column) -> Column:
    """What the headers of a part say, and its body."""
    head, body = part[0], part[1]
    kind, place = _value(head, "content-type"), _value(head, "content-disposition")
    mime = F.lower(F.regexp_extract(kind, r"^([^\s;/]+/[^\s;/]+)", 1))
    name = F.coalesce(F.nullif(_parameter(place, "filename"), F.lit("")), F.nullif(_parameter(kind, "name"), F.lit("")))
    return F.struct(F.when(mime == "", F.lit("text/plain")).otherwise(mime).alias("mime"), F.contains(place, F.lit("attachment")).alias("attached"), name.alias("name"),
                    F.lower(_parameter(kind, "charset")).alias("charset"), F.lower(_value(head, "content-transfer-encoding")).alias("encoding"), body.alias("body"))


def _decoded(field: Column) -> Column:
    return F.struct(*[field[c].alias(c) for c in ("mime", "attached", "name", "charset")], _bytes(field["encoding"], field["body"]).alias("data"))


def _read(field: Column) -> Column:
    content = F.when(~field["attached"], text_of(field["data"], field["charset"]))
    return F.struct(*[field[c].alias(c) for c in ("mime", "attached", "name", "data")], content.alias("content"))


def _part(field: Column, number: Column) -> Column:
    failed = field["data"].isNull() | (~field["attached"] & field["content"].isNull())
    return F.struct(number.alias("part_no"), field["mime"].alias("mime"), field["attached"].alias("is_attachment"), F.when(field["attached"], field["name"]).alias("filename"),
                    field["content"].alias("content"), F.when(field["attached"], field["data"]).alias("payload"), failed.alias("failed"))


def native_parts(head: Column, body: Column) -> Column:
    """The parts of a mail from its unfolded header lines and its body."""
    kind = _value(head, "content-type")
    boundary = F.nullif(_parameter(kind, "boundary"), F.lit(""))
    parted = F.coalesce(F.startswith(F.lower(kind), F.lit("multipart/")) & F.contains(body, F.concat(F.lit("--"), boundary)), F.lit(False))
    # The pattern starts with fixed text, which is searched in leaps. A carriage return before it is taken off afterwards, unless
    # the boundary's own line ends without one: then it is content.
    line = F.concat(F.lit(r"\n--\Q"), boundary, F.lit(r"\E"))
    bare = lambda p, after: F.when(F.endswith(p, F.lit("\r")) & ~F.startswith(after, F.lit("\n")), F.substr(p, F.lit(1), F.length(p) - 1)).otherwise(p)
    closed = F.split(F.concat(F.lit("\n"), body), F.concat(line, F.lit(r"--[ \t]*(?=\r?\n|$)")), 2)
    inner = rows.once(closed, lambda c: F.when(F.size(c) > 1, bare(c[0], c[1])).otherwise(c[0]))
    opened = F.split(inner, F.concat(line, F.lit(r"[ \t]*(?=\r?\n|$)")))
    pieces = rows.once(opened, lambda o: F.transform(o, lambda p, i: F.when(i < F.size(o) - 1, bare(p, F.get(o, i + 1))).otherwise(p)))
    pieces = F.transform(F.slice(pieces, 2, _ALL), lambda p: _split(F.regexp_replace(p, r"^\r?\n", "")))
    fields = F.transform(F.when(parted, pieces).otherwise(F.array(F.array(head, body))), _fields)
    single = lambda f: F.struct(*[(F.when(parted, f[c]).otherwise(F.lit(False)) if c == "attached" else f[c]).alias(c) for c in ("mime", "attached", "name", "charset", "encoding", "body")])
    return F.transform(F.transform(F.transform(F.transform(fields, single), _decoded), _read), _part)


# --- unusual mails ------------------------------------------------------------------------

def _marked(raw: str) -> tuple[str, bytes]:
    """The mail with a mark after each carriage return before a line that may be a boundary and ends without one, and the mark; b"" if there is none.

    The parser would take such a carriage return for a part of the line end.
    """
    mark = next((c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in raw), "") if _RETURN.search(raw) else ""
    return _RETURN.sub("\r" + mark, raw), mark.encode()


def _parts(raw: str) -> list[dict]:
    out: list[dict] = []
    raw, mark = _marked(raw or "")
    message = email.message_from_bytes(raw.encode("utf-8", "replace"), policy=email.policy.compat32)
    single = not message.is_multipart()
    for part in message.walk():
        attached = not single and "attachment" in str(part.get("Content-Disposition", ""))
        failed = False
        try:
            payload = part.get_payload(decode=True)
            payload = payload.replace(mark, b"") if payload and mark else payload
        except Exception:       # a broken part must not lose the mail
            payload, failed = None, True
        if payload is None and not attached and not failed:
            continue
        row = {"part_no": len(out), "mime": part.get_content_type(), "is_attachment": attached,
               "filename": part.get_filename() if attached else None, "content": None, "payload": None, "failed": failed}
        if attached:
            row["payload"] = payload
        elif not failed:
            try:
                row["content"] = payload.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                row["failed"] = True
        out.append(row)
    return out


@F.arrow_udf(T.ArrayType(PART))
def decoded_parts(raw: pa.Array) -> pa.Array:
    """The parts of every raw mail; NULL stays NULL."""
    return pa.array([None if r is None else _parts(r) for r in raw.to_pylist()], type=_ARROW)


def _header_text(value: str) -> str:
    """A header value with all its encoded words decoded; what can't be decoded stays."""
    word = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=")

    def text(m: re.Match) -> str:
        try:
            (data, charset), = email.header.decode_header(m[0])
            return data.decode(charset) if isinstance(data, bytes) else data
        except (LookupError, ValueError):
            return m[0]

    return word.sub(text, re.sub(r"(\?=)[ \t]+(=\?)", r"\1\2", value))


@F.arrow_udf(T.ArrayType(T.StringType()))
def decoded_headers(values: pa.Array) -> pa.Array:
    """Encoded words of any character set in a list of header values."""
    return pa.array([None if v is None else [None if x is None else _header_text(x) for x in v] for v in values.to_pylist()], type=pa.list_(pa.string()))


# --- tables -------------------------------------------------------------------------------

def part_rows(df: DataFrame) -> DataFrame:
    """Child table of parts: ``mail_id, part_no, mime, is_attachment, filename, sha256, n_chars, content, failed``."""
    from mailquarry.operators.mail import split_head
    raw = df.select("mail_id", F.coalesce("raw_email", F.lit("")).alias("raw_email"))
    raw = rows.with_fixed(raw, "_odd", unusual(F.col("raw_email")))
    usual = split_head(raw.where("NOT _odd")).select("mail_id", native_parts(F.col("head"), F.col("body")).alias("parts"))
    rest = raw.where("_odd").select("mail_id", decoded_parts("raw_email").alias("parts"))
    return (rows.explode_structs(usual.unionByName(rest), ["mail_id"], F.col("parts"), "part_no")
            .select("mail_id", "part_no", "mime", "is_attachment", "filename",
                    F.sha2("payload", 256).alias("sha256"),
                    F.length("content").alias("n_chars"), "content", "failed"))


def failed_parts(df: DataFrame) -> DataFrame:
    """Parts that could not be decoded: ``mail_id, part_no, mime``."""
    return part_rows(df).where("failed").select("mail_id", "part_no", "mime")


def body_columns(parts: Column) -> tuple[Column, Column, Column]:
    """Text body, HTML body and attachments from the decoded parts of a mail."""
    first = F.get(parts, F.lit(0))
    # A multipart container is no part itself, unless the parser found no parts in it.
    single = ~F.lower("content_type").rlike("^multipart/") | F.startswith(first["mime"], F.lit("multipart/"))

    def texts(kind: str) -> Column:
        wanted = F.filter(parts, lambda p: ~p["is_attachment"] & (p["mime"] == kind))
        return F.array_join(F.transform(wanted, lambda p: F.concat(p["content"], F.lit("\n"))), "")

    whole = F.coalesce(first["content"], F.lit(""))
    is_html = F.contains(first["mime"], F.lit("html"))
    attached = F.transform(F.filter(parts, lambda p: p["is_attachment"]), lambda p: F.struct(
        p["filename"].alias("filename"), F.sha2(p["payload"], 256).alias("sha256")))
    return (F.when(single, F.when(is_html, F.lit("")).otherwise(whole)).otherwise(texts("text/plain")),
            F.when(single, F.when(is_html, whole).otherwise(F.lit(""))).otherwise(texts("text/html")), attached)
