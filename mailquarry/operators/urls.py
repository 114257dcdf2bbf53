"""URL features, per link and per mail, and look-ups by registered domain."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import net, rows
from mailquarry.functions import text as X
from mailquarry.operators.reputation import lookup_join

# Letters outside Latin that look like Latin ones (Greek and Cyrillic blocks).
LOOKALIKE_SCRIPT = r"[\x{370}-\x{3FF}\x{400}-\x{52F}]"


def distinct_urls(links: DataFrame) -> DataFrame:
    """One row per link: repeated links cost one row after the map-side combine."""
    return links.select("url").distinct()


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    u = F.col(url)
    return df.select("*", net.scheme(u).alias("scheme"), net.netloc(u).alias("netloc"), net.path(u).alias("path"),
                     net.query(u).alias("query"))


def registered_domains(df: DataFrame, suffixes: Iterable[str] | None = None) -> DataFrame:
    return net.run_stages(df, net.domain_stages("url", suffixes))


def brand_in_subdomain(sub: Column, domain: Column) -> Column:
    """A brand in front of a registered domain that does not contain it."""
    brands = F.array(*[F.lit(b) for b in dict.fromkeys(L.BRANDS)])
    return (sub != "") & F.exists(brands, lambda b: F.contains(sub, b) & ~F.contains(domain, b))


def tld_risk(suffix: Column) -> Column:
    """1.0 risky, 0.0 safe, 0.5 anything else."""
    return F.when(suffix.isin(L.RISK_TLDS), F.lit(1.0)).when(suffix.isin(L.SAFE_TLDS), F.lit(0.0)).otherwise(F.lit(0.5))


def _lower(g) -> dict[str, Column]:
    return {"low": F.lower(g("url")), "nlow": F.lower(g("netloc"))}


def _lexical(g) -> dict[str, Column]:
    u, n, low = g("url"), g("netloc"), g("low")
    digits = F.length(n) - F.length(F.regexp_replace(n, "[0-9]", ""))
    listed = F.filter(F.array(*[F.lit(k) for k in L.URL_KEYWORDS]), lambda k: F.contains(low, k))
    return {
        "domain_length": F.length(g("domain")),
        "subdomain_depth": F.when(g("subdomain") == "", F.lit(0)).otherwise(F.size(F.split(g("subdomain"), r"\."))),
        "hyphen_count": F.length(g("domain")) - F.length(F.replace(g("domain"), F.lit("-"), F.lit(""))),
        "digit_ratio": F.when(n == "", F.lit(0.0)).otherwise(digits / F.length(n)),
        "url_entropy": X.entropy(u),
        "brand_in_subdomain": brand_in_subdomain(g("subdomain"), g("domain")).cast("int"),
        "tld_risk_score": tld_risk(g("suffix")),
        "is_ip_address": u.rlike(rf"^https?://{net.IPV4}").cast("int"),
        "punycode_detected": (F.contains(low, F.lit("xn--")) | n.rlike(LOOKALIKE_SCRIPT)).cast("int"),
        "url_shortener": X.contains_any(g("nlow"), L.SHORTENERS).cast("int"),
        "path_depth": F.regexp_count(net.path(u), F.lit("[^/]+")),
        "suspicious_keywords_in_url": F.size(listed) + F.when(F.contains(n, F.lit("@")), F.lit(3)).otherwise(F.lit(0)),
    }


def lexical_stages(suffixes: Iterable[str] | None = None, names: Iterable[str] = tuple(L.URL_FEATURES)) -> list[net.Stage]:
    """The stages of the lexical columns, or of some of them: what a struct in an array holds is computed whether it is read or not."""
    wanted = set(names)
    return [*net.domain_stages("url", suffixes), _lower, lambda g: {n: c for n, c in _lexical(g).items() if n in wanted}]


def url_lexical(urls: DataFrame, suffixes: Iterable[str] | None = None) -> DataFrame:
    """Twelve lexical columns per URL. Feed distinct URLs when the result is a dimension table."""
    return net.run_stages(urls, lexical_stages(suffixes)).select("url", *L.URL_FEATURES)


def url_features(mail: DataFrame, suffixes: Iterable[str] | None = None, first: int | None = None,
                 keep: Iterable[str] = ("mail_id",), names: Iterable[str] = tuple(L.URL_FEATURES)) -> DataFrame:
    """``url_*`` columns: maximum and mean of every lexical column in ``names`` over the links of a mail, or its ``first`` ones.

    The links stay in their row and are analysed by array transforms, so a mail is never exploded and
    re-grouped; ``url_count`` counts all links.
    """
    arr = net.run_stages_in_array(rows.first("urls", first), "url", lexical_stages(suffixes, names))
    staged = mail.select(*keep, F.size("urls").alias("url_count"), arr.alias("_u"))
    cols = []
    for f in names:
        values = F.col(f"_u.{f}")           # the field of every struct, as an array
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))
        cols.append(F.coalesce(F.array_max(values).cast("double"), F.lit(0.0)).alias(f"url_{f}_max"))
        cols.append(F.when(F.size("_u") == 0, F.lit(0.0)).otherwise(total / F.size("_u")).alias(f"url_{f}_mean"))
    return staged.select(*keep, F.greatest("url_count", F.lit(0)).alias("url_url_count"), *cols)


# --- domain look-ups ----------------------------------------------------------------------

def mail_domains(mail: DataFrame, suffixes: Iterable[str] | None = None, links: int | None = None,
                 limit: int | None = None) -> DataFrame:
    """``mail_id, domain``: the distinct registered domains of a mail; at most ``limit`` of its first ``links`` if given."""
    arr = net.run_stages_in_array(rows.first("urls", links), "url", net.domain_stages("url", suffixes))
    domains = F.array_distinct(F.filter(F.transform(arr, lambda s: s["domain"]), lambda d: d != ""))
    return rows.explode_values(mail, ["mail_id"], rows.first(domains, limit), "domain")


def whois_risk(domains: DataFrame, whois: DataFrame, as_of: str) -> DataFrame:
    """Age and registrar risk per domain from ``whois(domain, created, registrar)``; misses are -1 / 0.5 / 0.

    Of several records the oldest dated one counts as a whole. ``domains`` needs ``mail_id``, which spreads popular domains.
    """
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("created"))
    risk = F.when(age.isNull(), F.lit(0.5)).when(age < L.AGE_RISK_DAYS, F.lit(1.0)).when(age < L.AGE_WARN_DAYS, F.lit(0.5)).otherwise(F.lit(0.0))
    registrar = X.contains_any(F.lower(F.coalesce("registrar", F.lit(""))), L.ABUSE_REGISTRARS)
    one = whois.groupBy("domain").agg(F.min("created").alias("created"),
                                      F.when(F.count("created") > 0, F.min_by("registrar", "created")).otherwise(F.max("registrar")).alias("registrar"))
    return lookup_join(domains, one, "domain").select(
        *domains.columns, F.coalesce(age, F.lit(-1)).alias("domain_age_days"), risk.alias("domain_age_risk"),
        registrar.cast("double").alias("registrar_risk"))


def cert_risk(domains: DataFrame, cert_log: DataFrame, as_of: str, cap: int | None = None) -> DataFrame:
    """Certificate age, Let's Encrypt flag and foreign brand per domain.

    ``cert_log(domain, entry_no, not_before, issuer, san)``; with ``cap`` only the first entries of a domain
    count, as given by ``entry_no``. Either way the log is reduced by a plain aggregate.
    """
    used = cert_log if cap is None else cert_log.where(F.col("entry_no") <= cap)
    issuer, san = F.lower("issuer"), F.lower("san")
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("not_before").cast("date"))
    brand = brand_in_subdomain(san, F.col("domain"))
    per_domain = used.groupBy("domain").agg(
        F.min(age).alias("cert_age_days"),
        F.max((F.contains(issuer, F.lit("let's encrypt")) | F.contains(issuer, F.lit("lets encrypt"))).cast("int")).alias("cert_lets_encrypt"),
        F.max(brand.cast("int")).alias("cert_brand_mismatch"))
    return lookup_join(domains, per_domain, "domain").select(
        *domains.columns, F.coalesce("cert_age_days", F.lit(-1)).alias("cert_age_days"),
        F.coalesce("cert_lets_encrypt", F.lit(0)).alias("cert_lets_encrypt"),
        F.coalesce("cert_brand_mismatch", F.lit(0)).alias("cert_brand_mismatch"))


def worst_whois(per_domain: DataFrame) -> DataFrame:
    """Worst case per mail; a miss does not hide a known age."""
    known = F.min(F.when(F.col("domain_age_days") >= 0, F.col("domain_age_days")))
    return per_domain.groupBy("mail_id").agg(
        F.coalesce(known, F.lit(-1)).alias("url_domain_age_days"),
        F.max("domain_age_risk").alias("url_domain_age_risk"),
        F.max("registrar_risk").alias("url_registrar_risk"))


def worst_cert(per_domain: DataFrame) -> DataFrame:
    known = F.min(F.when(F.col("cert_age_days") >= 0, F.col("cert_age_days")))
    return per_domain.groupBy("mail_id").agg(
        F.coalesce(known, F.lit(-1)).alias("url_cert_age_days"),
        F.max("cert_lets_encrypt").alias("url_cert_lets_encrypt"),
        F.max("cert_brand_mismatch").alias("url_cert_brand_mismatch"))


# --- triage -------------------------------------------------------------------------------

def _triage_facts(g) -> dict[str, Column]:
    u, low, nlow = g("url"), g("low"), g("nlow")
    label, sub = g("label"), g("subdomain")
    digits = F.length(label) - F.length(F.regexp_replace(label, "[0-9]", ""))
    return {
        "brand_sub": X.first_present(sub, L.BRAND_OFFICIAL),
        "brand_dom": X.first_present(label, L.BRAND_OFFICIAL),
        "shortener": X.first_present(nlow, L.TRIAGE_SHORTENERS),
        "has_keyword": X.contains_any(low, L.TRIAGE_KEYWORDS),
        "digit_share": F.when(label == "", F.lit(0.0)).otherwise(digits / F.length(label)),
        "entropy": X.entropy(u),
        "port": net.port_of_netloc(g("netloc")),
        "depth": F.regexp_count(net.path(u), F.lit("[^/]+")),
        "sub_labels": F.when(sub == "", F.lit(0)).otherwise(F.size(F.split(sub, r"\."))),
    }


def official_site(brand: Column) -> Column:
    sites = F.create_map(*[F.lit(v) for pair in L.BRAND_OFFICIAL.items() for v in pair])
    return F.element_at(sites, brand)


def _triage_sites(g) -> dict[str, Column]:
    return {"site_sub": official_site(g("brand_sub")), "site_dom": official_site(g("brand_dom"))}


def _triage_checks(g) -> dict[str, Column]:
    u, n = g("url"), g("nlow")
    not_official = (n != g("site_dom")) & ~F.endswith(n, F.concat(F.lit("."), g("site_dom")))
    # (severity rank, reason, condition); rank as in lists.SEVERITIES
    checks = [
        (3, "risky_tld", g("suffix").isin(L.TRIAGE_TLDS)),
        (4, "brand_in_subdomain", g("brand_sub").isNotNull() & ~F.contains(n, g("site_sub"))),
        (3, "brand_in_domain", g("brand_sub").isNull() & g("brand_dom").isNotNull() & not_official),
        (3, "ip_host", u.rlike(rf"^https?://{net.IPV4}")),
        (2, "shortener", g("shortener").isNotNull()),
        (2, "keywords", g("has_keyword")),
        (2, "digit_domain", (g("label") != "") & (g("digit_share") > 0.4)),
        (2, "high_entropy", g("entropy") > 5.2),
        (3, "punycode", F.contains(g("low"), F.lit("xn--"))),
        (4, "credentials_in_host", F.contains(n, F.lit("@"))),
        (2, "odd_port", F.coalesce(~g("port").isin(0, 80, 443), F.lit(False))),
        (1, "nested_subdomain", g("sub_labels") >= 3),
        (3, "plain_http_keywords", F.startswith(u, F.lit("http://")) & g("has_keyword")),
        (0, "deep_path", g("depth") >= 4),
    ]
    hits = F.filter(F.array(*[
        F.struct(F.when(F.coalesce(cond, F.lit(False)), F.lit(rank)).alias("rank"), F.lit(reason).alias("reason"))
        for rank, reason, cond in checks]), lambda s: s["rank"].isNotNull())
    return {"hits": hits}


def _triage_result(g) -> dict[str, Column]:
    top = F.coalesce(F.array_max(F.transform(g("hits"), lambda s: s["rank"])), F.lit(0))
    reasons = F.transform(g("hits"), lambda s: s["reason"])
    return {
        "severity_rank": top,
        "severity": F.element_at(F.array(*[F.lit(s) for s in L.SEVERITIES]), top + 1),
        "reasons": F.when(F.size(reasons) == 0, F.array(F.lit("none"))).otherwise(reasons),
    }


def triage_stages(suffixes: Iterable[str] | None = None) -> list[net.Stage]:
    return [*net.domain_stages("url", suffixes), _lower, _triage_facts, _triage_sites, _triage_checks, _triage_result]


def url_triage(urls: DataFrame, suffixes: Iterable[str] | None = None) -> DataFrame:
    """Fourteen lexical checks per URL: severity and reasons. Schema links (w3.org) and stubs are skipped."""
    real = urls.where(~F.contains("url", F.lit("w3.org")) & (F.length("url") >= 10))
    return net.run_stages(real, triage_stages(suffixes)).select(
        *urls.columns, F.col("nlow").alias("domain"), "severity", "severity_rank", "reasons")


def triaged_links(urls: Column, suffixes: Iterable[str] | None = None, first: int | None = None) -> Column:
    """The same inside a mail row: array of structs for all links, or the ``first`` ones."""
    real = F.filter(rows.first(urls, first), lambda u: ~F.contains(u, F.lit("w3.org")) & (F.length(u) >= 10))
    return net.run_stages_in_array(real, "url", triage_stages(suffixes))
