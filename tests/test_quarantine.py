"""Faults of hand-made mails; good rows stay as they are."""

import pytest
from pyspark.sql import functions as F

from mailquarry.operators import mail, quarantine

MAILS = [
    (1, "From: a@x.com\nDate: Mon, 3 Jun 2024 10:00:00 +0100 (IST)\nSubject: fine\n\nsee http://a.com/x", "spam"),
    (2, None, "0"),
    (3, " \n\t", "1"),
    (4, "Date: soon\n\nx", None),
    (5, "Date: Mon, 31 Feb 2024 10:00:00 GMT\n\nx", "ham"),
    (6, "Content-Type: text/plain; charset=x-nothing\n\ntext", "ham"),
    (7, "Subject: l\n\ngo to http:///nowhere and https://good.com/", "dunno"),
    (8, "no header at all", "ham"),
    (9, "Date: 3 Jun 2024 10:00 GMT\n\nno day, no seconds", "ham"),
    (None, "Subject: who\n\nx", "ham"),
    (10, "Subject: long\n\n" + "word " * 300_000, "ham"),
    (8, "no header at all", "ham"),
    (11, "Content-Type: multipart/mixed; boundary=B\n\n--B\n\nfirst\n--B\nContent-Type: text/plain; charset=x-nothing\n\nlost\n--B--\n", "ham"),
]
WANT = {
    (2, "input", "no text"), (3, "input", "no text"), (4, "header", "unreadable date: soon"), (5, "header", "unreadable date: Mon, 31 Feb 2024 10:00:00 GMT"),
    (6, "mime", "part 0 can't be decoded: text/plain"), (7, "link", "no host: http:///nowhere"), (7, "label", "unknown label: dunno"), (None, "input", "no id"),
    (11, "mime", "part 1 can't be decoded: text/plain"),
}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(MAILS, "mail_id long, raw_email string, label string")


def test_faults(raw):
    flagged = quarantine.with_faults(raw, "label")
    got = [(r.mail_id, r.stage, r.reason) for r in quarantine.failed_rows(flagged).collect()]
    assert len(got) == len(WANT) and set(got) == WANT
    assert flagged.count() == len(MAILS)


def test_good_rows_are_unchanged(raw):
    good = quarantine.good_rows(quarantine.with_faults(raw, "label"))
    plain = mail.parse_mail(raw.where("mail_id IN (1, 8, 9, 10)"))
    assert good.columns == plain.columns
    assert good.exceptAll(plain).isEmpty() and plain.exceptAll(good).isEmpty()


def test_counts_are_taken_on_the_way(raw):
    flagged, seen = quarantine.counted(quarantine.with_faults(raw, "label"))
    flagged.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_rows": 13, "n_failed": 8, "n_input": 3, "n_header": 2, "n_mime": 2, "n_link": 1, "n_label": 1}


def test_empty_table_and_no_label(raw):
    assert quarantine.failed_rows(quarantine.with_faults(raw.limit(0))).isEmpty()
    assert quarantine.with_faults(raw).where("mail_id = 7").select(F.size("faults")).first()[0] == 1
