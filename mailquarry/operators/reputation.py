"""Reputation joins: facts with snapshots of what look-up services answered; unknown is -1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import net, rows
from mailquarry.operators.mail import sender_ip

SALTS = 16
TOOLS = ["vt", "gsb", "urlhaus", "urlscan", "abuseipdb", "ipqs"]


def fits_broadcast(df: DataFrame) -> bool:
    """True when the planner's size estimate is under the session's broadcast limit."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    units = {"b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}
    text = str(limit).lower()
    number = text.rstrip("kmgb")
    size = int(number) * units.get(text[len(number):] or "b", 1)
    return 0 <= int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= size


def lookup_join(facts: DataFrame, dim: DataFrame, key: str, spread: str = "mail_id", salts: int = SALTS) -> DataFrame:
    """LEFT JOIN of facts with a table that has one row per key.

    A small table is broadcast (its size is checked). Otherwise both sides are salted: the dimension is
    repeated ``salts`` times and each fact picks one copy by the hash of ``spread``, so a key that holds a
    third of all facts is shared by many tasks. No fact is lost or doubled.
    """
    if fits_broadcast(dim):
        return facts.join(F.broadcast(dim), key, "left")
    if spread == key:       # facts are unique per key: nothing to spread
        return facts.join(dim, key, "left")
    salted = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
            .join(salted, [key, "_salt"], "left").drop("_salt"))


def one_per_key(dim: DataFrame, *keys: str) -> DataFrame:
    """One row per key: of several answers the largest by its columns from left to right, so no fact is doubled."""
    values = [c for c in dim.columns if c not in keys]
    return dim.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_v")).select(*keys, "_v.*")


def _with_defaults(defaults: dict[str, int]) -> list[Column]:
    return [F.coalesce(F.col(n), F.lit(d)).alias(n) for n, d in defaults.items()]


def rep_url(links: DataFrame, url_rep: DataFrame) -> DataFrame:
    """Engine counts per link from ``url_rep(url, malicious, suspicious, clean, reputation)``."""
    dim = url_rep.select("url", F.col("malicious").alias("vt_malicious"), F.col("suspicious").alias("vt_suspicious"),
                         F.col("clean").alias("vt_clean"), F.col("reputation").alias("vt_reputation"))
    out = lookup_join(links, one_per_key(dim, "url"), "url")
    return out.select(*links.columns, *_with_defaults({k: L.INTEL_DEFAULTS[k] for k in (
        "vt_malicious", "vt_suspicious", "vt_clean", "vt_reputation")}))


def rep_domain(domains: DataFrame, domain_rep: DataFrame) -> DataFrame:
    """The same per registered domain."""
    return rep_url(domains.withColumnRenamed("domain", "url"), domain_rep.withColumnRenamed("domain", "url")) \
        .withColumnRenamed("url", "domain")


def rep_blocklist(links: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Per mail: is any link listed, and how many entries match (``blocklist(url, threat)``)."""
    counts = blocklist.groupBy("url").agg(F.count("*").alias("_n"))
    hits = lookup_join(links.select("mail_id", "url"), counts, "url")
    return hits.groupBy("mail_id").agg(
        F.max(F.col("_n").isNotNull().cast("int")).alias("gsb_is_flagged"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("int").alias("gsb_threat_count"))


def rep_malware_url(links: DataFrame, malware_urls: DataFrame) -> DataFrame:
    """1 listed, 0 checked and not listed, -1 unknown, from ``malware_urls(url, listed)``."""
    dim = malware_urls.groupBy("url").agg(F.max(F.col("listed").cast("int")).alias("urlhaus_threat"))
    out = lookup_join(links, dim, "url")
    return out.select(*links.columns, F.coalesce("urlhaus_threat", F.lit(-1)).alias("urlhaus_threat"))


def rep_ip(mail_ips: DataFrame, ip_rep: DataFrame) -> DataFrame:
    """Abuse score, reports and exit-node flag of a sender address; private addresses are not looked up."""
    dim = ip_rep.select("ip", F.col("score").alias("abuse_confidence_score"), F.col("reports").alias("abuse_total_reports"),
                        F.col("is_tor").alias("abuse_is_tor"))
    public = mail_ips.withColumn("_key", F.when(~net.is_private_ip(F.col("ip"), L.PRIVATE_PREFIXES_REPUTATION), F.col("ip")))
    # A NULL key matches nothing, but NULLs would gather in one task: give them spread-out keys instead.
    public = public.withColumn("_key", F.coalesce("_key", F.concat(F.lit("-"), F.col("mail_id").cast("string"))))
    out = lookup_join(public, one_per_key(dim.withColumnRenamed("ip", "_key"), "_key"), "_key")
    return out.select(*mail_ips.columns, *_with_defaults({k: -1 for k in (
        "abuse_confidence_score", "abuse_total_reports", "abuse_is_tor")}))


def rep_scan(links: DataFrame, url_scan: DataFrame) -> DataFrame:
    """Scan verdict, brand flag and number of redirects from ``url_scan(url, malicious, brand, redirects)``."""
    dim = url_scan.select("url", F.col("malicious").alias("urlscan_malicious"), F.col("brand").alias("urlscan_brand_impersonated"),
                          F.col("redirects").alias("urlscan_redirect_count"))
    out = lookup_join(links, one_per_key(dim, "url"), "url")
    return out.select(*links.columns, *_with_defaults({k: -1 for k in (
        "urlscan_malicious", "urlscan_brand_impersonated", "urlscan_redirect_count")}))


def rep_fraud(keys: DataFrame, fraud_rep: DataFrame) -> DataFrame:
    """Fraud scores of ``keys(mail_id, kind, key)`` from ``fraud_rep(kind, key, score, flagged)``."""
    merged = fraud_rep.select(F.concat_ws(":", "kind", "key").alias("_k"), F.col("score").alias("fraud_score"),
                              F.col("flagged").alias("fraud_flag"))
    out = lookup_join(keys.withColumn("_k", F.concat_ws(":", "kind", "key")), one_per_key(merged, "_k"), "_k")
    return out.select(*keys.columns, F.coalesce("fraud_score", F.lit(-1)).alias("fraud_score"),
                      F.coalesce("fraud_flag", F.lit(-1)).alias("fraud_flag"))


def primary_links(mail: DataFrame) -> DataFrame:
    """``mail_id, url``: the first link of each mail that has one."""
    return rows.explode_values(mail, ["mail_id"], F.slice("urls", 1, 1), "url")


def sender_ips(mail: DataFrame) -> DataFrame:
    """``mail_id, ip``: the sender address of each mail that has a public one."""
    return rows.explode_values(mail, ["mail_id"], F.array(sender_ip(F.col("received"))), "ip")


def intel_features(mail: DataFrame, links: DataFrame, url_rep: DataFrame, blocklist: DataFrame, url_scan: DataFrame,
                   malware_urls: DataFrame, ip_rep: DataFrame) -> DataFrame:
    """The 13 ``intel_*`` columns by name, with defaults where nothing is known.

    The answers on the first link come from one chain of joins keyed by URL; only the small per-mail
    results meet the list of mails.
    """
    first = rep_scan(rep_malware_url(rep_url(primary_links(mail), url_rep), malware_urls), url_scan).drop("url")
    block = rep_blocklist(links, blocklist)
    ips = rep_ip(sender_ips(mail), ip_rep).drop("ip")
    out = (mail.select("mail_id").join(first, "mail_id", "left").join(block, "mail_id", "left").join(ips, "mail_id", "left"))
    return out.select("mail_id", *[F.coalesce(F.col(n), F.lit(d)).alias(f"intel_{n}") for n, d in L.INTEL_DEFAULTS.items()])


# --- verdicts of the single services ------------------------------------------------------

def tool_verdicts(df: DataFrame) -> DataFrame:
    """One verdict per service. A missing answer (-1 or NULL) is N/A and never a hit.

    Needs the ``intel_*`` columns and ``fraud_url_score``, ``fraud_url_flag``, ``fraud_email_score``,
    ``fraud_ip_score`` (-1 when unknown).
    """
    c = F.col
    bad, odd, ok, na = (F.lit(v) for v in ("MALICIOUS", "SUSPICIOUS", "CLEAN", "N/A"))
    vt = (F.when(c("intel_vt_malicious") > 0, bad).when(c("intel_vt_suspicious") > 0, odd)
          .when(c("intel_vt_malicious") == -1, na).otherwise(ok))
    gsb = F.when(c("intel_gsb_is_flagged") == 1, bad).when(c("intel_gsb_is_flagged") == 0, ok).otherwise(na)
    urlhaus = F.when(c("intel_urlhaus_threat") == 1, bad).when(c("intel_urlhaus_threat") == 0, ok).otherwise(na)
    scan = (F.when(c("intel_urlscan_malicious") == 1, bad).when(c("intel_urlscan_brand_impersonated") == 1, odd)
            .when(c("intel_urlscan_malicious") == -1, na).otherwise(ok))
    score = c("intel_abuse_confidence_score")
    abuse = F.when(score == -1, na).when(score >= 50, bad).when(score >= 20, odd).otherwise(ok)
    risk, mail_fraud, ip_fraud = c("fraud_url_score"), c("fraud_email_score"), c("fraud_ip_score")
    fraud = (F.when((c("fraud_url_flag") == 1) | (risk >= 75), bad)
             .when((risk >= 50) | (mail_fraud >= 75) | (ip_fraud >= 75), odd)
             .when((risk == -1) & (mail_fraud == -1), na).otherwise(ok))
    return df.select("*", *[e.alias(f"{t}_verdict") for t, e in zip(TOOLS, (vt, gsb, urlhaus, scan, abuse, fraud), strict=True)])


def tool_tally(df: DataFrame) -> DataFrame:
    """Per service: number of mails per verdict."""
    pairs = F.array(*[F.struct(F.lit(t).alias("tool"), F.col(f"{t}_verdict").alias("verdict")) for t in TOOLS])
    return df.select(F.inline(pairs)).groupBy("tool").agg(
        F.count_if(F.col("verdict") == "MALICIOUS").alias("malicious"),
        F.count_if(F.col("verdict") == "SUSPICIOUS").alias("suspicious"),
        F.count_if(F.col("verdict") == "CLEAN").alias("clean"),
        F.count_if(F.col("verdict") == "N/A").alias("not_checked"))


def evidence_table(url_facts: DataFrame, ip_facts: DataFrame, address_facts: DataFrame) -> DataFrame:
    """Evidence per indicator: ``mail_id, ioc, type, weight, verdict, detail``.

    ``url_facts`` needs the engine counts and ``urlhaus_threat``, ``ip_facts`` the abuse columns,
    ``address_facts`` ``key`` and ``fraud_score``; indicators without an answer are left out, links excepted.
    """
    c = F.col
    mal, sus = F.greatest(c("vt_malicious"), F.lit(0)), F.greatest(c("vt_suspicious"), F.lit(0))
    urls = url_facts.select(
        "mail_id", F.col("url").alias("ioc"), F.lit("URL").alias("type"),
        F.when((mal > 0) | (c("urlhaus_threat") == 1), F.lit("MALICIOUS")).when(sus > 0, F.lit("SUSPICIOUS")).otherwise(F.lit("CLEAN")).alias("verdict"),
        F.concat(F.lit("engines "), mal, F.lit("/"), mal + F.greatest(c("vt_clean"), F.lit(0))).alias("detail"))
    score = c("abuse_confidence_score")
    ips = ip_facts.where(score != -1).select(
        "mail_id", c("ip").alias("ioc"), F.lit("IP").alias("type"),
        F.when(score >= 50, F.lit("MALICIOUS")).when(score >= 20, F.lit("SUSPICIOUS")).otherwise(F.lit("CLEAN")).alias("verdict"),
        F.concat(F.lit("confidence "), score, F.lit("%")).alias("detail"))
    addresses = address_facts.where(c("fraud_score") != -1).select(
        "mail_id", c("key").alias("ioc"), F.lit("Email").alias("type"),
        F.when(c("fraud_score") >= 75, F.lit("SUSPICIOUS")).otherwise(F.lit("CLEAN")).alias("verdict"),
        F.concat(F.lit("fraud "), c("fraud_score"), F.lit("/100")).alias("detail"))
    weight = F.lit("MEDIUM")
    for kind, w in L.INDICATOR_WEIGHT.items():
        weight = F.when(c("type") == kind, F.lit(w)).otherwise(weight)
    return urls.unionByName(ips).unionByName(addresses).withColumn("weight", weight)
