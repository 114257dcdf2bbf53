"""Input views for the queries, derived in SQL from the given tables.

The text is plain SQL that Spark and DuckDB read the same way, so both sides start from equal rows.
Sizes follow the tables: one mail per document, one HTML mail per page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Link templates: the id of the mail modulo m goes between the two halves.
_POOL = [
    ("http://news", ".example.com/a", 997),
    ("https://shop.example.co.uk/item/", "/view/now/page", 100000000),
    ("http://paypal.secure-login", ".xyz/verify/account/reset/now", 50),
    ("http://xn--pypal-4ve", ".com/login", 40),
    ("http://203.0.113.", "/update/index.html", 250),
    ("http://files.example.org:8080/f", ".zip", 300),
    ("http://paypal.com@evil", ".tk/login?cmd=go", 60),
    ("https://bit.ly/x", "", 80),
    ("https://tinyurl.com/t", "", 70),
    ("http://win-prize", ".top/claim", 90),
    ("https://www.gov.ie/page/", "", 500),
    ("http://host", ".unknownzone/path", 120),
    ("https://eur01.safelinks.protection.outlook.com/?url=http%3A%2F%2Fevil", ".example.xyz%2Flogin&data=05", 64),
    ("https://urldefense.proofpoint.com/v2/url?u=http-3A__bad", ".example.ru_pay-2Dnow&d=DwMF", 48),
    ("https://urldefense.com/v3/__https://real", ".example.net/a/b__;abc123$", 55),
    ("https://www.google.com/url?q=http://phish", ".example.tk/secure&sa=D", 45),
    ("https://track.example.com/r?redirect=https://dest", ".example.info/x", 33),
    ("https://track.example.com/r?next=https://track.example.com/same", "", 35),
    ("https://nam02.safelinks.protection.outlook.com/?url=https%3A%2F%2Furldefense.com%2Fv3%2F__http%3A%2F%2Fdeep", ".example.click%2Fq__%3Btok", 38),
    ("http://pct", ".example.com/a%2Fb%20c?x=1+2", 77),
    ("https://go.example.com/?u=http%3A%2F%2Fother", ".example.biz%2Fp+q", 41),
    ("http://a.b.c.d", ".deep.example.com/one/two/three/four/five", 66),
    ("HTTP://UPPER", ".Example.COM/Case", 51),
    ("http://trail", ".example.com/end).", 43),
    ("https://protect-eu.mimecast.com/s/tok", "", 37),
    ("https://links.barracudanetworks.com/abc?url=http://barr", ".example.site/z", 39),
    ("http://microsoft-support", ".com/office365/validate", 47),
    ("https://login.microsoftonline.com/common/", "", 600),
    ("http://9847201", ".cc/a", 58),
    ("https://example.edu/", "", 1000),
    ("http://lone", ".example.com/50%off", 62),
    ("https://amazon.account-verify", ".co.ie/signin/token=1", 53),
    ("http://google.com/?q=", "", 44),
    ("https://cdn.example.net/lib/", ".js", 700),
    ("http://www.dhl-parcel", ".online/track", 49),
    ("https://t.co/s", "", 42),
]
_POOL_ROWS = ",\n  ".join(f"({i}, '{pre}', '{post}', {m})" for i, (pre, post, m) in enumerate(_POOL))
_N = len(_POOL)
_SLOTS = 6


def _slot(i: int) -> str:
    return f"(k * {2 * i + 1} + {i * 7}) % {_N}"


_LINKS = "\n    ".join(
    f"|| CASE WHEN k % 7 >= {i} THEN ' ' || p{i}.pre || CAST(k % p{i}.m AS STRING) || p{i}.post ELSE '' END"
    for i in range(1, _SLOTS + 1))
_MANY = " || ".join(f"' http://n{i}.list' || s || '.example.org/'" for i in range(1, 25))
_JOINS = "\n  ".join(f"JOIN link_pool p{i} ON p{i}.t = {_slot(i)}" for i in range(1, _SLOTS + 1))

_RELAYS = "\n    ".join(
    f"|| CASE WHEN k % 8 > {i} THEN 'Received: from relay{i}.example.net (relay{i} ['"
    f" || CASE (k + {i}) % 7 WHEN 0 THEN '10.0.0.' || CAST(k % 250 AS STRING) WHEN 1 THEN '192.168.1.7'"
    f" WHEN 2 THEN '203.0.113.' || CAST(k % 200 AS STRING) WHEN 3 THEN '198.51.100.' || CAST(k % 90 AS STRING)"
    f" WHEN 4 THEN '8.8.{i}.' || CAST(k % 30 AS STRING) WHEN 5 THEN '172.16.4.{i}' ELSE '127.0.0.1' END"
    f" || '])' || chr(10) || '  by mx.example.org; Mon, 3 Jun 2024 10:0{i}:00 '"
    f" || CASE (k + {i}) % 4 WHEN 0 THEN '+0000' WHEN 1 THEN '+0100 (IST)' WHEN 2 THEN '-0500' ELSE '+0530' END"
    f" || chr(10) ELSE '' END" for i in range(8))

_HEADERS = f"""
    'From: ' || CASE k % 9 WHEN 0 THEN '"PayPal Support"' WHEN 1 THEN '"Amazon"' WHEN 2 THEN 'Jane Roe'
       WHEN 3 THEN '"Google Accounts"' ELSE '"Example Team"' END || ' <user' || s || '@' || sender || '>' || chr(10)
    || 'To: staff@corp.example.com' || chr(10)
    || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'Reply-To: help@' || sender || chr(10)
       ELSE 'Reply-To: collect' || s || '@' || CASE k % 2 WHEN 0 THEN 'gmail.com' ELSE 'drop.example.info' END || chr(10) END
    || CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'Return-Path: <bounce@' || sender || '>' || chr(10)
       WHEN 2 THEN 'Return-Path: <b@bounce.' || sender || '>' || chr(10) ELSE 'Return-Path: <x@mailer.example.biz>' || chr(10) END
    || 'Subject: ' || CASE k % 12 WHEN 0 THEN 'URGENT ACTION REQUIRED!!' WHEN 1 THEN 'Re: your invoice' WHEN 2 THEN 'You won $$$ today?'
       WHEN 3 THEN 'PayPal account suspended' WHEN 4 THEN 'Meeting notes' WHEN 5 THEN 'FW: RE: parcel'
       WHEN 6 THEN 'Please verify your AMAZON order' WHEN 7 THEN '' WHEN 8 THEN 'Weekly report ' || s
       WHEN 9 THEN 'fwd: Security alert' WHEN 10 THEN 'Lunch?' ELSE 'Newsletter No ' || s END || chr(10)
    || 'Date: Mon, 3 Jun 2024 10:00:00 ' || CASE k % 4 WHEN 0 THEN '+0000' WHEN 1 THEN '+0100' WHEN 2 THEN '-0500' ELSE '+0200' END || chr(10)
    || CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'Message-ID: <m' || s || '@' || sender || '>' || chr(10)
       WHEN 2 THEN 'Message-ID: m' || s || chr(10) WHEN 3 THEN 'Message-ID: <m' || s || '@gmail.com>' || chr(10)
       ELSE 'Message-ID: <m' || s || '@mx.example.org>' || chr(10) END
    || CASE k % 10 WHEN 0 THEN 'X-Mailer: PHPMailer 5.2' || chr(10) WHEN 1 THEN 'X-Mailer: Outlook 16' || chr(10) ELSE '' END
    {_RELAYS}
    || CASE k % 8 WHEN 0 THEN 'Authentication-Results: mx; spf=pass; dkim=pass; dmarc=pass' || chr(10)
       WHEN 1 THEN 'Authentication-Results: mx; spf=fail; dkim=none; dmarc=fail' || chr(10)
       WHEN 2 THEN 'Authentication-Results: mx; spf=softfail' || chr(10)
       WHEN 3 THEN 'Authentication-Results: mx; dkim=fail' || chr(10) || 'DKIM-Signature: v=1; a=rsa-sha256' || chr(10)
       WHEN 4 THEN 'Received-SPF: Pass (spf = pass)' || chr(10)
       WHEN 5 THEN 'Authentication-Results: mx; spf=neutral; dkim=temperror; dmarc = permerror' || chr(10)
       WHEN 6 THEN 'Authentication-Results: mx; spf=pass; dkim=pass; dmarc=odd' || chr(10) ELSE '' END
    || CASE WHEN k % 6 = 0 THEN 'X-Originating-IP: [192.0.2.' || CAST(k % 40 AS STRING) || ']' || chr(10) ELSE '' END"""

_SENDER = """CASE {k} % 6 WHEN 0 THEN 'paypal.com' WHEN 1 THEN 'mail.paypal-secure.xyz' WHEN 2 THEN 'aib.ie'
     WHEN 3 THEN 'example.co.uk' WHEN 4 THEN 'accounts.google.evil' || CAST({k} % 25 AS STRING) || '.top' ELSE 'gmail.com' END"""

CORPUS = """
SELECT mail_id, CASE WHEN mail_id % 50 = 7 THEN '??' ELSE label END AS label,
       CASE WHEN mail_id % 25 = 3 THEN '  ' || chr(10) ELSE raw_email END AS raw_email, source
FROM (
  SELECT d.doc_id AS mail_id,
         CASE WHEN l.toxic IS NULL THEN NULL
              WHEN l.toxic = 1 THEN CASE d.doc_id % 4 WHEN 0 THEN '1' WHEN 1 THEN 'spam' WHEN 2 THEN ' Phishing Email' ELSE 'TRUE' END
              ELSE CASE d.doc_id % 4 WHEN 0 THEN '0' WHEN 1 THEN 'ham' WHEN 2 THEN 'Safe Email ' ELSE 'false' END END AS label,
         d.text AS raw_email, d.source AS source
  FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT 1000000000 + conv_id * 1000 + turn, '0', text, 'chat' FROM {conversations}
  UNION ALL
  SELECT 2000000000 + item_id, '1', text, 'bench' FROM {benchmark}
) u"""

# One mail in 13 has a text part and an attachment, one a base64 body; base64 is a call that each engine spells its way.
_CUT = "'--cut-' || s || '-x'"
_FRAMED = f"""CASE mail_id % 13
    WHEN 6 THEN 'MIME-Version: 1.0' || chr(10) || 'Content-Type: multipart/mixed; boundary="cut-' || s || '-x"' || chr(10) || chr(10)
      || {_CUT} || chr(10) || 'Content-Type: text/plain; charset=utf-8' || chr(10) || chr(10) || body || chr(10)
      || {_CUT} || chr(10) || 'Content-Type: application/octet-stream' || chr(10) || 'Content-Disposition: attachment; filename="f' || s || '.bin"' || chr(10)
      || 'Content-Transfer-Encoding: base64' || chr(10) || chr(10) || {{b64}}md5(s){{b64_end}} || chr(10) || {_CUT} || '--' || chr(10)
    WHEN 7 THEN 'Content-Type: text/plain; charset=utf-8' || chr(10) || 'Content-Transfer-Encoding: base64' || chr(10) || chr(10) || {{b64}}body{{b64_end}} || chr(10)
    ELSE chr(10) || body END"""

MAIL_RAW = f"""
WITH link_pool(t, pre, post, m) AS (VALUES
  {_POOL_ROWS}),
base AS (
  SELECT doc_id AS k, CAST(doc_id AS STRING) AS s, text, source, {_SENDER.format(k="doc_id")} AS sender FROM {{documents}}),
page AS (
  SELECT page_id AS k, CAST(page_id AS STRING) AS s, html, {_SENDER.format(k="page_id")} AS sender FROM {{pages}})
SELECT mail_id, head || {_FRAMED} AS raw_email, label, source
FROM (
  SELECT k AS mail_id, s, {_HEADERS} AS head, text {_LINKS}
    || CASE WHEN k % 17 = 3 THEN {_MANY} ELSE '' END
    || CASE WHEN k % 11 = 2 THEN ' hxxp[://]defang' || CAST(k % 30 AS STRING) || '[.]example(.)ru/pay' ELSE '' END
    || CASE WHEN k % 10 = 3 THEN ' md5 ' || md5(s) || ' sha ' || md5(s) || md5('x' || s) || ' setup.exe' ELSE '' END
    || CASE k % 4 WHEN 1 THEN chr(10) || 'Urgent: click here immediately'
       WHEN 2 THEN chr(10) || 'Please verify your identity within 24 hours or your account will be closed'
       WHEN 3 THEN chr(10) || 'final notice' ELSE '' END AS body,
    CAST(CASE WHEN k % 3 = 2 OR k % 9 = 0 THEN 1 ELSE 0 END AS INT) AS label, source
  FROM base
  {_JOINS}) plain
UNION ALL
SELECT 1000000000 + k AS mail_id,
    {_HEADERS}
    || 'Content-Type: text/html; charset=utf-8' || chr(10)
    || chr(10) || html || CASE k % 10
       WHEN 0 THEN '<p><a href="http://evil' || s || '.example.xyz/login">www.paypal.com</a> <a href="https://www.example.org/a">example.org</a></p>'
       WHEN 1 THEN '<a href="http://203.0.113.9/x">bank.example.com</a><form action="https://collect.example.top/p"><input name="a"></form>'
       WHEN 2 THEN '<div style="display: none">x</div><span style="font-size:0px">y</span><b style="opacity: 0.5">z</b><i style="opacity:0">w</i>'
       WHEN 3 THEN '<img src="https://t.example.com/tracking/p.gif"><img width="1" height="1" src="https://px' || s || '.example.net/1.gif">'
       WHEN 4 THEN '<img src="data:image/png;base64,iVBORw0KGgo="><div hidden>q</div><p style="text-indent:-9999px">r</p>'
       WHEN 5 THEN '<link rel="stylesheet" href="https://cdn.example.com/a.css"><link rel="stylesheet" href="/local.css">'
       WHEN 6 THEN '<meta http-equiv="refresh" content="0; url=http://next.example.com/">'
       WHEN 7 THEN '<script>1</script><script>2</script><script src="http://s.example.com/x.js"></script>'
       WHEN 8 THEN '<form action="/local"></form><a href="https://one.example.com">1</a><a href="https://two.example.de/">2</a><a href="https://shop.example.com/x">3</a>'
         || '<a title="a > b" href="https://four.example.net/q">www.bank.example.com</a><img alt="src=''http://fake.example.com/'' >" src="https://real.example.net/' || s || '.png">'
         || '<b title="<!-- ">t</b><i title="-->">u</i><script data-x="a>b">hidden > here</script>'
       ELSE '<span style="color:#ffffff">h</span><td style="height:0;">h</td><iframe src="https://frame.example.click/in"></iframe>' END AS raw_email,
    CAST(CASE WHEN k % 3 = 2 OR k % 9 = 0 THEN 1 ELSE 0 END AS INT) AS label, 'pages' AS source
FROM page"""

# One mail in five has a fault, each kind in one of 30.
MAIL_FAULTY = """
SELECT mail_id, CASE mail_id % 30
    WHEN 1 THEN NULL
    WHEN 6 THEN ' ' || chr(10) || chr(10) || '  '
    WHEN 11 THEN replace(raw_email, 'Date: Mon, 3 Jun 2024', 'Date: Mon, 33 Jun 2024')
    WHEN 16 THEN 'Content-Type: text/plain; charset=x-nothing' || chr(10) || raw_email
    WHEN 21 THEN raw_email || CASE WHEN mail_id % 13 IN (6, 7) THEN '' ELSE chr(10) || 'see http:///nowhere/' || CAST(mail_id AS STRING) || ' now' END
    ELSE raw_email END AS raw_email,
    CASE WHEN mail_id % 30 = 26 THEN 'perhaps' WHEN mail_id % 30 = 27 THEN NULL ELSE CAST(label AS STRING) END AS label, source
FROM ({mails}) m"""

MAIL_MIME = """
SELECT doc_id AS mail_id,
    'From: a@example.com' || chr(10) || 'Subject: parts' || chr(10) || 'MIME-Version: 1.0' || chr(10)
    || 'Content-Type: multipart/mixed; boundary="b-' || CAST(doc_id AS STRING) || '-x"' || chr(10) || chr(10)
    || '--b-' || CAST(doc_id AS STRING) || '-x' || chr(10) || 'Content-Type: text/plain; charset=utf-8' || chr(10) || chr(10)
    || text || chr(10) || '--b-' || CAST(doc_id AS STRING) || '-x' || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(10) || chr(10)
    || '<p>' || text || '</p>' || chr(10) || '--b-' || CAST(doc_id AS STRING) || '-x' || chr(10)
    || 'Content-Type: application/octet-stream' || chr(10) || 'Content-Disposition: attachment; filename="f' || CAST(doc_id AS STRING) || '.bin"' || chr(10)
    || 'Content-Transfer-Encoding: base64' || chr(10) || chr(10) || {b64} || chr(10)
    || '--b-' || CAST(doc_id AS STRING) || '-x--' || chr(10) AS raw_email
FROM {documents}"""

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def _spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small file that comes as fewer splits; large tables are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _spread(df) if name in ("documents", "pages") else df


def _view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three corpora with mixed label spellings: ``mail_id, label, raw_email, source``."""
    return _view(spark, sf_dir, CORPUS, "documents", "labels", "conversations", "benchmark")


def mail_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw mails: ``mail_id, raw_email, label, source``."""
    return _view(spark, sf_dir, MAIL_RAW.replace("{b64}", "replace(base64(encode(").replace("{b64_end}", ", 'UTF-8')), chr(13) || chr(10), '')"), "documents", "pages")


def mail_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw mails with planted faults."""
    return spark.sql(MAIL_FAULTY.format(mails="SELECT * FROM {mails}"), mails=mail_raw(spark, sf_dir))


def mail_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw mails with a text part, an HTML part and an attachment each."""
    return _view(spark, sf_dir, MAIL_MIME.replace("{b64}", "base64(encode(text, 'UTF-8'))"), "documents")
