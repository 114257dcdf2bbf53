"""Variants against a plain version character by character, and what a score doesn't read is not computed."""

import pytest
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions.mix import P, begun, picked
from mailquarry.operators import features, mail, variants

TEXTS = ["", "a", "\n\n", "From: x\n\n", "From: apeX\n\nabcdefghij" * 30, "no body é漢😀 " * 20, "S: x\n\n" + "é漢😀 a-b_1 ǅ ́​ ЖxX\r\n\n\n" * 25, "\n\nabc" * 9, "x\n" * 40, None]


def _mix(*parts):
    h = 7
    for p in parts:
        h = (h * 48271 + p % P) % P
        h = (h * h + 1_013_904_223) % P
    return h


def _pick(n, *parts):
    return (_mix(*parts) >> 7) % n


def _plain(attack, text, i):
    if text is None or i is None:
        return text
    if attack == "homoglyph_substitution":
        return "".join(L.LOOKALIKES.get(c, c) if _pick(5, 42, 3, i, k) == 0 else c for k, c in enumerate(text))
    head, gap, body = text.partition("\n\n")
    return head + gap + "".join(c + L.ZERO_WIDTH[_pick(5, 42, 2, i, k)] if c.isalpha() and _pick(10, 42, 1, i, k) == 0 else c for k, c in enumerate(body))


@pytest.mark.parametrize("attack", ["whitespace_insertion", "homoglyph_substitution"])
def test_characters_are_changed_as_picked(spark, attack):
    ids = [*range(len(TEXTS)), 10**12, -7, None]
    texts = [*TEXTS, *TEXTS[4:7]]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "mail_id long, raw_email string")
    changed = variants.apply(df, attack)
    got = {r.mail_id: r.raw_email for r in changed.collect()}
    assert got == {i: _plain(attack, t, i) for i, t in zip(ids, texts, strict=True)} and got[4] != TEXTS[4]
    plan = changed._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan                # a lambda for every character took most of the time


def test_numbers_of_positions_are_single_picks(spark):
    start = spark.range(1).select(begun(F.lit(42), F.lit(1), F.lit(9)).alias("s")).first().s
    import numpy as np
    assert picked(10, start, np.arange(200)).tolist() == [_pick(10, 42, 1, 9, i) for i in range(200)]


def test_named_features_are_those_of_the_whole_table(spark):
    names = ["url_tld_risk_score_max", "hdr_spf_result", "txt_urgency_phrase_count"]
    raw = spark.createDataFrame([(1, "From: a@b.com\n\nurgent http://x.tk/a http://y.com"), (2, "x"), (3, None)], "mail_id long, raw_email string")
    parsed = mail.parse_mail(raw)
    few = features.scalar_features(parsed, names=names)
    assert few.columns == ["mail_id", *names]
    assert sorted(few.collect()) == sorted(features.scalar_features(parsed).select("mail_id", *names).collect())
    assert "url_entropy" not in few._jdf.queryExecution().optimizedPlan().toString()
