"""Hand-made mails with known rows."""

import base64
import hashlib
import quopri

import pytest
from pyspark.sql import functions as F

from mailquarry.functions import text as X
from mailquarry.operators import indicators, mail, mime

PDF = b"%PDF-1.4 fake"
B64 = base64.b64encode(PDF).decode()
GOLDEN = {
    1: "From: a@x.com\nSubject: Hi\n\nplain http://a.com/x. end",
    2: "From: a@x.com\nContent-Type: text/html\n\n<a href='https://b.com/y'>b</a><img src=\"http://c.com/p.gif\">",
    3: ("From: a@x.com\nContent-Type: multipart/mixed; boundary=\"B\"\n\n--B\nContent-Type: text/plain\n\nhello http://d.com\n--B\n"
        f"Content-Type: application/pdf\nContent-Disposition: attachment; filename=\"f.pdf\"\nContent-Transfer-Encoding: base64\n\n{B64}\n--B--\n"),
    4: "Subject: b\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"secret http://e.com/z").decode(),
    5: "Subject: q\nContent-Transfer-Encoding: quoted-printable\nContent-Type: text/plain; charset=iso-8859-1\n\ncaf=E9 =3D",
    6: "Subject: =?utf-8?B?w6l0w6k=?= sale\n\nx",
    7: "Subject: =?UTF-8?Q?caf=C3=A9_now?=\n\nx",
    8: "Subject: one\n folded line\nSubject: two\n\nx",
    9: "no header at all\n\nsecond paragraph http://f.com",
    10: "",
    11: "Subject: only headers\n",
    12: "From: a@x.com\r\nSubject: crlf\r\n\r\nbody\r\nline",
    13: "Subject: =?iso-8859-1?Q?caf=E9?=\n\nx",
    14: "Received: from a\nReceived: from b\n\nHTTP://UP.com/A http://g.com http://g.com, (http://h.com)",
    15: "Content-Type: multipart/alternative; boundary=zz\n\nno parts here",
    16: "Subject: big\n\n" + "word " * 400_000 + "http://last.com/end",
    17: "Subject: unknown\nContent-Type: text/plain; charset=x-nothing\n\ntext",
}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(GOLDEN.items()), "mail_id long, raw_email string")
    return {r["mail_id"]: r for r in mail.parse_mail(df).collect()}


def test_every_mail_once(rows):
    assert set(rows) == set(GOLDEN)


def test_plain_and_html(rows):
    assert (rows[1]["body_text"], rows[1]["urls"]) == ("plain http://a.com/x. end", ["http://a.com/x"])
    assert rows[2]["urls"] == ["https://b.com/y", "http://c.com/p.gif"]
    assert rows[2]["body_text"] == ""


def test_parts(rows):
    assert rows[3]["body_text"] == "hello http://d.com\n"
    assert [(a["filename"], a["sha256"]) for a in rows[3]["attachments"]] == [("f.pdf", hashlib.sha256(PDF).hexdigest())]


def test_transfer_encodings(rows):
    assert rows[4]["urls"] == ["http://e.com/z"]
    assert rows[5]["body_text"] == "café ="


def test_encoded_words(rows):
    assert rows[6]["subject"] == "été sale"
    assert rows[7]["subject"] == "café now"
    assert rows[13]["subject"] == "café"


def test_headers(rows):
    assert rows[8]["subject"] == "one folded line"
    assert (rows[9]["subject"], rows[9]["body_text"]) == ("", GOLDEN[9])
    assert rows[10]["body_text"] == "" and rows[11]["subject"] == "only headers"
    assert (rows[12]["subject"], rows[12]["body_text"]) == ("crlf", "body\r\nline")


def test_links(rows):
    assert rows[14]["received"] == ["from a", "from b"]
    assert rows[14]["urls"] == ["HTTP://UP.com/A", "http://g.com", "http://h.com"]
    assert rows[16]["urls"] == ["http://last.com/end"]      # the whole text is read


def test_broken_mails_are_kept(rows):
    assert rows[15]["body_text"] == "no parts here"
    assert rows[17]["body_text"] == ""


def test_part_rows(spark):
    df = spark.createDataFrame([(3, GOLDEN[3])], "mail_id long, raw_email string")
    got = [(r["part_no"], r["mime"], r["is_attachment"], r["filename"]) for r in mime.part_rows(df).orderBy("part_no").collect()]
    assert got == [(0, "text/plain", False, None), (1, "application/pdf", True, "f.pdf")]


def test_undecodable_part_is_kept(spark):
    raw = ("From: a@example.com\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=\"b\"\n\n--b\nContent-Type: text/plain; charset=no-such-set\n\nlost?\n"
           "--b\nContent-Type: text/plain; charset=utf-8\n\nkept\n--b--\n")
    df = spark.createDataFrame([(1, raw), (2, None), (3, "")], "mail_id bigint, raw_email string")
    assert [(r.mail_id, r.part_no, r.mime) for r in mime.failed_parts(df).collect()] == [(1, 0, "text/plain")]
    bodies = {r.mail_id: r for r in mail.parse_mail(df).select("mail_id", "body_text", "attachments").collect()}
    assert bodies[1].body_text == "kept\n" and bodies[1].attachments == []
    assert set(bodies) == {1, 2, 3}


def test_word_count_knows_all_blanks(spark):
    texts = ["", " ", "a", "one two three", "x\x1cy\tz\r\nw", "é　ü "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(X.word_count(F.col("t")).alias("n")).collect()] == [0, 0, 1, 3, 4, 2]


def _mail(kind, encoding, charset, data, attached="", eol="\n"):
    head = [f"Content-Type: {kind}" + (f"; charset={charset}" if charset else "")]
    head += [f"Content-Transfer-Encoding: {encoding}"] * bool(encoding) + [f"Content-Disposition: attachment;\n filename=\"{attached}\""] * bool(attached)
    return eol.join(head) + eol + eol + data


def test_native_parts_equal_the_library(spark):
    """Every encoding, character set and shape that expressions take, against the standard library's parser."""
    text = "Grüße, façade = 100 %\n\n  =?x\n"
    bodies = []
    for charset in ("utf-8", "UTF-8", "iso-8859-1", "windows-1252", "ISO-8859-15", "us-ascii", ""):
        raw = text.encode(charset or "utf-8", "replace")
        bodies += [("base64", charset, base64.encodebytes(raw).decode()), ("quoted-printable", charset, quopri.encodestring(raw).decode()), ("BASE64", charset, base64.b64encode(raw).decode().rstrip("="))]
    bodies += [("base64", "koi8-r", base64.b64encode("Привет".encode("koi8-r")).decode()), ("", "utf-8", text), ("8bit", "", text), ("quoted-printable", "utf-8", "a=\nb=ZZ =3d=\r\nc")]
    mails = [_mail("text/plain", *b) for b in bodies] + ["Subject: x\n\njust text", "Content-Type: text/html\r\n\r\n<p>a</p>\r\n"]
    for eol in ("\n", "\r\n"):
        for mark in ('"a b=c"', "q1", '"x?y(z)"'):
            cut = mark.strip('"')
            parts = [_mail("text/plain", *bodies[k], eol=eol) for k in (0, 1, 5, 22)] + [_mail("text/html", "", "utf-8", "<p>é</p>", eol=eol), _mail("application/pdf", "base64", "", B64, "f 1.pdf", eol),
                     eol + "no header", _mail("image/png; name=i.png", "base64", "", "AAECAw==", "", eol).replace("Content-Transfer", "Content-Disposition: attachment" + eol + "Content-Transfer")]
            whole = f"Subject: m{eol}Content-Type: multipart/mixed; boundary={mark}{eol}{eol}preamble{eol}" + "".join(f"--{cut}{eol}{p}{eol}" for p in parts) + f"--{cut}--{eol}epilogue"
            mails += [whole, whole.replace(f"--{cut}--", "")]
    df = mail.split_head(spark.createDataFrame(list(enumerate(mails)), "mail_id int, raw_email string"))
    assert df.where(mime.unusual(F.col("raw_email"))).isEmpty()
    for r in df.select("mail_id", mime.native_parts(F.col("head"), F.col("body")).alias("parts")).collect():
        want = mime._parts(mails[r.mail_id])
        got = [p.asDict() | {"payload": p.payload and bytes(p.payload)} for p in r.parts]
        assert got == want, mails[r.mail_id]


def test_unusual_mails(spark):
    """Nested parts, sets of several bytes, encoded file names and unknown encodings take the way through the library."""
    raw = ["Content-Type: multipart/mixed; boundary=a\n\n--a\nContent-Type: multipart/alternative; boundary=b\n\n--b\n\nin\n--b--\n--a--\n", "Content-Type: text/plain; charset=shift_jis\n\nx",
           "Content-Type: message/rfc822\n\nSubject: y\n\nz", "Content-Type: a/b; name*=utf-8''x\n\n", "Content-Transfer-Encoding: x-uuencode\n\nx", "Subject: =?big5?B?pKQ=?=\n\n"]
    plain = ["Subject: =?utf-8?q?a?=\n\n", "Content-Type: text/plain; charset=\"utf-8\"\n\n", "", "text with charset in it", "Content-Type: text/plain; charset=koi8-r;\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw + plain)] + [(99, None)], "mail_id int, raw_email string")
    assert [r.mail_id for r in df.where(mime.unusual(F.col("raw_email"))).orderBy("mail_id").collect()] == list(range(len(raw)))
    rows = {r.mail_id: r for r in mail.parse_mail(df).collect()}
    assert len(rows) == len(raw) + len(plain) + 1
    assert rows[0].body_text == "in\n" and rows[5].subject == "中"


def test_parts_are_derived_once(spark, sf):
    """No copy of the derivation below the generator of parts, and base64 text is cleaned once."""
    from pyspark.sql import functions as F
    from mailquarry.operators import mime
    from mailquarry.plans import fixtures
    plan = mime.part_rows(fixtures.mail_mime(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate inline"):]
    assert "size(" not in "".join(line for line in below.splitlines() if "Filter" in line and "transform" in line)
    for text, want in (("aGVsbG8=", b"hello"), ("aGVs\r\nbG8", b"hello"), ("a G-V_s*bG8=junk", b"hello"), ("aGVsb", b"hel"), ("", b"")):
        assert spark.createDataFrame([(text,)], "t string").select(mime.base64_bytes(F.col("t"))).first()[0] == want, text
    plan = spark.range(1).select(mime.base64_bytes(F.col("id").cast("string")).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_halves_equal_a_split(spark):
    from pyspark.sql import functions as F
    from mailquarry.operators import mime
    texts = [None, "", "a", "\n\n", "\n\nb", "a\n\n", "a\r\n\r\nb\n\nc", "a\r\r\n\nb", "a\n\r\n\r\nb", "\U0001f600 h\n\n\U0001f600 b\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(mime.halves(F.col("t")).alias("got"), F.split("t", "\r?\n\r?\n", 2).alias("want")).collect():
        assert r.got == r.want


def _three_parts(i: int, text: str, end: str = "\n") -> str:
    cut = f"--b{i}{end}"
    data = base64.b64encode(text.encode()).decode()
    return (f"From: a@example.com{end}Content-Type: multipart/mixed; boundary=b{i}{end}{end}{cut}Content-Type: text/plain; charset=utf-8{end}{end}{text}{end}{cut}"
            f"Content-Type: application/octet-stream{end}Content-Disposition: attachment; filename=f{end}Content-Transfer-Encoding: base64{end}{end}{data}{end}--b{i}--{end}")


TEXTS = ["", "a", "a\r", "\r", "charset=big5 a\r", "charset=big5 \ufdd0\r", "a\r\n--c\nb\r", "charset=big5\r\n--c\nb"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_parts_keep_every_byte(spark, end):
    """Empty parts have a hash, and a carriage return is content where the boundary's line ends without one."""
    df = spark.createDataFrame([(i, _three_parts(i, t, end)) for i, t in enumerate(TEXTS)], "mail_id long, raw_email string")
    want = {i: (t, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(TEXTS)}
    parts = {(r.mail_id, r.part_no): r for r in mime.part_rows(df).collect()}
    assert {i: (parts[i, 0].content, parts[i, 1].sha256) for i in want} == want
    mails = {r.mail_id: r for r in mail.parse_mail(df).collect()}
    assert {i: (m.body_text, m.attachments[0].sha256) for i, m in mails.items()} == {i: (t + "\n", h) for i, (t, h) in want.items()}


def test_an_empty_attachment_is_no_indicator(spark):
    df = mail.parse_mail(spark.createDataFrame([(i, _three_parts(i, t)) for i, t in enumerate(TEXTS[:2])], "mail_id long, raw_email string"))
    got = {r.mail_id: r.attachment_hashes for r in indicators.indicator_arrays(df).collect()}
    assert got == {0: [None], 1: [hashlib.sha256(b"a").hexdigest()]}
