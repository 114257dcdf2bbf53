"""The twelve header features: expressions over parsed mail columns, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import net
from mailquarry.functions import text as X


def _address_stages(suffixes: Iterable[str] | None) -> list[net.Stage]:
    """``_from``, ``_reply`` and ``_path``: registered domains, the whole domain where the suffix is unknown."""
    fields = {"_from": "from_address", "_reply": "reply_to", "_path": "return_path"}

    def reg(g, k: str) -> Column:
        r = net.registered(g(k), g(f"{k}_s"))
        return F.when(r == "", g(k)).otherwise(r)

    return [
        lambda g: {k: F.lower(net.address_domain(g(c))) for k, c in fields.items()},
        lambda g: {f"{k}_s": net.suffix(g(k), suffixes) for k in fields},
        lambda g: {k: reg(g, k) for k in fields},
    ]


def relay_diversity(received: Column) -> Column:
    """1 when public-looking relay addresses span more than two /16 networks.

    Whole addresses are used; private ones (10/8, 192.168/16, 127/8) do not count.
    """
    ips = F.flatten(F.transform(received, net.ips_in))
    nets = F.array_distinct(F.transform(
        F.filter(ips, lambda ip: ~ip.rlike(r"^(?:10\.|192\.168\.|127\.)")),
        lambda ip: F.substring_index(ip, ".", 2)))
    return F.coalesce(((F.size(received) >= 2) & (F.size(ips) >= 2) & (F.size(nets) > 2)), F.lit(False)).cast("int")


def auth_score(text: Column, check: str) -> Column:
    """Score of spf / dkim / dmarc in lower-cased result text, NULL when absent or unknown."""
    scores = F.create_map(*[F.lit(v) for pair in L.AUTH_SCORES.items() for v in pair])
    return F.element_at(scores, F.regexp_extract(text, rf"\b{check}\s*=\s*(\w+)", 1))


def auth_columns(auth: Column, spf_header: Column, signed: Column) -> dict[str, Column]:
    """spf, dkim, dmarc as 1 / 0 / -1; neutral 0 when nothing is stated."""
    text = F.lower(F.concat(auth, F.lit(" "), spf_header))
    stated = (auth != "") | (spf_header != "")
    dkim = F.coalesce(auth_score(text, "dkim"), F.lit(0))
    return {
        "spf_result": F.coalesce(auth_score(text, "spf"), F.lit(0)),
        "dkim_result": F.when(stated & (signed == 1), F.greatest(dkim, F.lit(0))).otherwise(dkim),
        "dmarc_result": F.coalesce(auth_score(text, "dmarc"), F.lit(0)),
    }


def message_id_suspicious(mid: Column) -> Column:
    freemail = F.lower(mid).rlike("(?:^|@)(?:" + "|".join(d.replace(".", r"\.") for d in L.FREEMAIL) + ")[^@]*$")
    return ((mid == "") | ~X.strip(mid).rlike("^<[^@]+@[^>]+>") | freemail).cast("int")


def timezone_mismatch(date: Column, received: Column) -> Column:
    zone = r"([+-][0-9]{4})"
    mine = F.regexp_extract(date, zone, 1)
    origin = F.regexp_extract(F.coalesce(F.try_element_at(received, F.lit(-1)), F.lit("")), zone, 1)
    return ((mine != "") & (origin != "") & (mine != origin)).cast("int")


def header_features(mail: DataFrame, suffixes: Iterable[str] | None = None, strict_injection: bool = False,
                    keep: Iterable[str] = ("mail_id",)) -> DataFrame:
    """``hdr_*`` columns.

    ``header_injection_attempt`` looks for CR, LF or NUL in the header dump.
    The dump joins headers with LF, so it fires for every mail with two headers; with
    ``strict_injection`` only CR and NUL count.
    """
    c = F.col
    # The registered domains first, so each is computed once.
    staged = net.run_stages(mail, _address_stages(suffixes))
    freemail = "|".join(d.replace(".", r"\.") for d in L.FREEMAIL)
    bad = r"[\r\x00]" if strict_injection else r"[\r\n\x00]"
    cols = {
        "from_reply_to_mismatch": ((c("_from") != "") & (c("_reply") != "") & (c("_from") != c("_reply"))).cast("int"),
        "from_return_path_mismatch": ((c("_from") != "") & (c("_path") != "") & (c("_from") != c("_path"))).cast("int"),
        "reply_to_freemail": c("reply_to").rlike(f"(?i)@({freemail})").cast("int"),
        "received_hop_count": F.size("received"),
        "received_geo_anomaly": relay_diversity(c("received")),
        **auth_columns(c("auth_results"), c("received_spf_header"), c("dkim_signed")),
        "message_id_suspicious": message_id_suspicious(c("message_id")),
        "timezone_mismatch": timezone_mismatch(c("date"), c("received")),
        "x_mailer_suspicious": c("x_mailer").rlike("(?i)" + "|".join(L.BULK_MAILERS)).cast("int"),
        "header_injection_attempt": c("header_raw").rlike(bad).cast("int"),
    }
    return staged.select(*keep, *[cols[n].alias(f"hdr_{n}") for n in L.HEADER_FEATURES])


def dns_policy(domains: DataFrame, dns_txt: DataFrame) -> DataFrame:
    """SPF, DKIM and DMARC policy scores of sender domains from a snapshot of DNS TXT records.

    ``dns_txt(domain, kind, selector, txt)`` holds published records, several per domain and kind at
    most. It is reduced to one row per domain before the join, so the join cannot multiply rows.
    """
    txt, low = F.col("txt"), F.lower("txt")
    spf = F.when(F.contains(low, F.lit("v=spf1")), F.when(
        F.contains(txt, F.lit("~all")) | F.contains(txt, F.lit("?all")), F.lit(0)).otherwise(F.lit(1)))
    dmarc = F.when(F.contains(low, F.lit("v=dmarc1")), F.when(F.contains(low, F.lit("p=reject")), F.lit(1))
                   .when(F.contains(low, F.lit("p=quarantine")), F.lit(0)).otherwise(F.lit(-1)))
    scored = dns_txt.select(
        "domain",
        F.when(F.col("kind") == "spf", spf).alias("spf"),
        F.when((F.col("kind") == "dkim") & F.col("selector").isin(L.DKIM_SELECTORS), F.lit(1)).alias("dkim"),
        F.when(F.col("kind") == "dmarc", dmarc).alias("dmarc"))
    best = scored.groupBy("domain").agg(F.max("spf").alias("spf"), F.max("dkim").alias("dkim"), F.max("dmarc").alias("dmarc"))
    return (domains.join(best, "domain", "left")
            .select(*domains.columns, *[F.coalesce(F.col(k), F.lit(-1)).alias(f"{k}_policy") for k in ("spf", "dkim", "dmarc")]))
