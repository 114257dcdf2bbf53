"""Tags whose values hold markup, against what a browser reads."""

import pytest
from pyspark.sql import functions as F

from mailquarry.functions import tags
from mailquarry.operators import html, mail

CASES = [
    ('<a title="a>b" href="http://x.com/">t</a>', ['<a title="a>b" href="http://x.com/">'], ["http://x.com/"]),
    ("<a title='a > \"b\"' href=http://x.com/p?q=1>t</a>", ["<a title='a > \"b\"' href=http://x.com/p?q=1>"], ["http://x.com/p?q=1"]),
    ('<a data-href="http://no.com" href="http://yes.com">t</a>', ['<a data-href="http://no.com" href="http://yes.com">'], ["http://yes.com"]),
    ('<a title=" href=\'http://no.com\' " HREF = "http://yes.com">t</a>', ['<a title=" href=\'http://no.com\' " HREF = "http://yes.com">'], ["http://yes.com"]),
    ('<b title="<!--">x</b><a href="/in">y</a><b title="-->">', ['<b title="<!--">', '<a href="/in">', '<b title="-->">'], ["/in"]),
    ('<!-- <a href="/gone"> --><script a="x>y">"<a href=\'/raw\'>"</script><a href="/kept">', ['<script a="x>y">', '<a href="/kept">'], ["/kept"]),
    ('<a href="open>text</a>', ['<a href="open>'], [""]),
    ("<a href='it''s'>q</a>", ["<a href='it''s'>"], ["it"]),
    ('<a/href="/s"/>', ['<a/href="/s"/>'], ["/s"]),
    ("<a href>x</a>", ["<a href>"], [""]),
    ("1 < 2 and <", [], []),
    ("", [], []),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_tags_and_links(scanned, i):
    assert (scanned[i]["_tags"], scanned[i]["hrefs"]) == CASES[i][1:]


@pytest.fixture(scope="module")
def scanned(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "mail_id long, body_html string")
    links = F.transform(F.filter("_tags", lambda t: t.rlike("(?i)^<a\\b")), lambda t: tags.attribute(t, "href"))
    return {r["mail_id"]: r for r in html.with_tags(df, "body_html").withColumn("hrefs", links).collect()}


def test_long_and_broken_pages(spark):
    many = "<p " + " ".join(f'a{i}="v>{i}"' for i in range(20_000)) + ' href="/end">'
    open_tag = "<p " + " ".join(f'a{i}="v{i}"' for i in range(20_000))
    df = spark.createDataFrame([(1, many), (2, open_tag), (3, None)], "mail_id long, body_html string")
    got = {r["mail_id"]: r for r in html.with_tags(df, "body_html").withColumn("end", F.transform("_tags", lambda t: tags.attribute(t, "href"))).collect()}
    assert (got[1]["_tags"], got[1]["end"]) == ([many], ["/end"])
    assert got[2]["_tags"] == [] and got[3]["_tags"] is None


def test_features_and_links_of_a_mail(spark):
    page = '<a title="a > b" href="https://four.example.net/q">www.bank.example.com</a><img alt="src=\'http://fake.example.org/\' >" width=1 height=1 src="//px.example.net/i.png">'
    df = spark.createDataFrame([(1, "Content-Type: text/html\n\n" + page)], "mail_id long, raw_email string")
    parsed = mail.parse_mail(df)
    assert "https://four.example.net/q" in parsed.first()["urls"]
    row = html.html_features(parsed).first()
    assert (row.html_href_text_mismatch_count, row.html_tracking_pixel_count, row.html_total_links, row.html_unique_domains_in_links) == (1, 1, 1, 1)
