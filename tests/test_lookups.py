"""Look-ups stay one to one, and no link is lost to a default limit."""

import random
import re

from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import net
from mailquarry.operators import corpus, reputation, urls, verdict


def test_repeated_answers_do_not_double_facts(spark):
    links = spark.createDataFrame([(1, "http://a/"), (2, "http://b/")], "mail_id long, url string")
    rep = spark.createDataFrame([("http://a/", 0, 0, 1, 0), ("http://a/", 3, 0, 1, 0)], "url string, malicious int, suspicious int, clean int, reputation int")
    assert sorted((r.mail_id, r.vt_malicious) for r in reputation.rep_url(links, rep).collect()) == [(1, 3), (2, -1)]
    answers = spark.createDataFrame([(1, '{"is_phishing": false}'), (1, '{"is_phishing": true}')], "mail_id long, answer string")
    assert sorted((r.mail_id, r.ai_is_phishing) for r in verdict.ai_answers(links, answers).collect()) == [(1, 1), (2, -1)]


def test_whois_fields_come_from_one_record(spark):
    domains = spark.createDataFrame([(1, "a.com")], "mail_id long, domain string")
    whois = spark.sql("SELECT 'a.com' AS domain, DATE '2024-01-01' AS created, 'Good' AS registrar UNION ALL SELECT 'a.com', DATE '2024-05-01', 'NAMECHEAP INC'")
    got = urls.whois_risk(domains, whois, "2024-06-01").first()
    assert (got.domain_age_days, got.registrar_risk) == (152, 0.0)


def test_all_links_count_unless_limited(spark):
    mails = spark.createDataFrame([(1, [f"http://h{i}.com/" for i in range(30)] + ["http://1.2.3.4/"])], "mail_id long, urls array<string>")
    assert urls.url_features(mails).first().url_is_ip_address_max == 1.0
    assert urls.url_features(mails, first=20).first().url_is_ip_address_max == 0.0
    assert urls.mail_domains(mails).count() > urls.mail_domains(mails, limit=5).count() == 5


def test_texts_with_one_opening_are_kept(spark):
    df = spark.createDataFrame([(1, "a", "x" * 200 + "1"), (2, "a", "x" * 200 + "2"), (3, "a", " " + "X" * 200 + "2")], "mail_id long, source string, raw_email string")
    ids = lambda **k: sorted(r.mail_id for r in corpus.drop_near_duplicates(df, **k).collect())
    assert ids() == [1, 2] and ids(prefix=200) == [1]


def test_all_public_suffixes_are_known(spark):
    """Country, new, wildcard, excepted and international suffixes; a made-up ending stays without one."""
    want = {"a.bank.pl": "bank.pl", "x.shop.co.za": "shop.co.za", "a.b.co.nz": "b.co.nz", "www.foo.app": "foo.app", "foo.dev": "foo.dev", "m.foo.com.cn": "foo.com.cn",
            "a.b.c.ck": "b.c.ck", "x.www.ck": "www.ck", "a.city.kobe.jp": "city.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "shop.xn--p1ai": "shop.xn--p1ai", "shop.рф": "shop.рф",
            "c.ck": "", "host.unknownzone": "", "10.0.0.1": "", "": ""}
    got = spark.createDataFrame([(h,) for h in want], "host string").select("host", net.registered_domain(F.col("host")).alias("domain")).collect()
    assert {r["host"]: r["domain"] for r in got} == want


def test_suffix_by_hash_table(spark):
    """Against the rules read one by one: plain ones, wildcards, exceptions, hosts that are suffixes, addresses, odd dots."""
    rules = [*L.SUFFIXES]
    plain = {r for r in rules if r[0] not in "*!"}

    def want(host):
        if re.fullmatch(net.IPV4, host):
            return ""
        labels = host.split(".")
        tails = [".".join(labels[k:]) for k in range(len(labels))]
        for t in tails:
            if "!" + t in rules:
                return t.split(".", 1)[1]
        for k, t in enumerate(tails):
            if t in plain or "." in t and "*." + t.split(".", 1)[1] in rules:
                return t
        return ""

    rules = set(rules)
    rnd = random.Random(1)
    names = sorted(r.lstrip("!*.") for r in rules)
    hosts = ["", ".", "a..com", "com", "ck", "www.ck", "a.www.ck", "x.ck", "a.x.ck", "city.kawasaki.jp", "a.city.kawasaki.jp", "b.kawasaki.jp", "c.b.kawasaki.jp", "1.2.3.4", "host.unknownzone", "co.uk", "a.b.co.uk"]
    hosts += [".".join([rnd.choice("abc")] * rnd.randint(0, 3) + [rnd.choice(names)]) for _ in range(800)]
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", net.suffix(F.col("host")).alias("s"), net.suffix(F.col("host"), []).alias("none")).collect()
    assert [(r.host, r.s) for r in got] == [(h, want(h)) for h in hosts] and {r.none for r in got} == {""}
