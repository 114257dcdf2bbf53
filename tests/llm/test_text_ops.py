"""Operators in Python tasks against plain versions, with nulls, empty texts, repeated rows, empty tables and extra columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailquarry.llm import decontaminate, htmltext, langid, neardup, packing, quality, repeats, suffixes, tokenfiles, tokens
from mailquarry.llm.queries import TOKENIZER
from mailquarry.llm.tokens import Encoder
from mailquarry.plans.staging import scratch

DOCS = [(1, "The old house by the river. It's 3 miles off!"), (2, None), (3, ""), (4, "  naïve \n\n'tis 日本 x"), (4, "  naïve \n\n'tis 日本 x"), (None, "no id"), (7, "word " * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have the names that operators use inside."""
    return spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, start string, score int")


@pytest.fixture(scope="module")
def ids():
    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    return [np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for _, t in DOCS]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_encoder_equals_library():
    rnd, encoder = random.Random(1), Encoder(TOKENIZER)
    parts = ["'", "s", "re", "'ll", " ", "  ", "\n", "\t", "é", "1", "²", "!", "中", "’", "<|endoftext|>", "\U0010ffff", "́"]
    texts = ["", " ", *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(500))]
    got, borders = encoder.encode(texts)
    assert all(got[a:b].tolist() == [*want, 0] for a, b, want in zip(borders, borders[1:], encoder.whole(texts)))


def test_encoder_takes_more_words_than_its_table(monkeypatch):
    """A text of distinct words beyond the table, after a full table and next to short texts."""
    monkeypatch.setattr(tokens, "MAX_WORDS", 100)
    encoder = Encoder(TOKENIZER)
    texts = [" ".join(f"w{i * 7919}x" for i in range(90)), "a b", " ".join(f"{i * 104729}y" for i in range(1000)), "", "end"]
    for part in (texts[:1], texts, texts[2:3]):
        got, borders = encoder.encode(part)
        assert len(borders) == len(part) + 1
        assert all(got[a:b].tolist() == [*want, 0] for a, b, want in zip(borders, borders[1:], encoder.whole(part), strict=False))


def test_encoder_compares_words(monkeypatch):
    """Words that a polynomial hash can't tell apart, and a hash that gives all words a few values."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    pair = [word, word.translate({97: 98, 98: 97})]
    texts = [*pair, f"{pair[1]} {pair[0]}", "to be or not to be", "that is the question", " to  be", "be to", "b", ""]
    for small in (False, True):
        if small:
            monkeypatch.setattr(tokens, "word_hash", lambda data, start, stop: (stop - start).astype(np.uint64) // np.uint64(8))
        encoder = Encoder(TOKENIZER)
        for part in (texts, texts[::-1], texts[1:]):
            got, borders = encoder.encode(part)
            assert all(got[a:b].tolist() == [*want, 0] for a, b, want in zip(borders, borders[1:], encoder.whole(part), strict=False))


def test_packing(spark, docs, ids):
    pieces = packing.pack(docs, TOKENIZER, window=64).toPandas()
    assert sorted(zlib.crc32(x) for x in (b"".join(g.sort_values("start").ids) for _, g in pieces[pieces.doc_id.isin([1, 2, 3, 7])].groupby("doc_id"))) == sorted(
        zlib.crc32(ids[k].tobytes()) for k in (0, 1, 2, 6))
    assert pieces.length.sum() == sum(map(len, ids))
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 64 and g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
    assert packing.pack(empty(spark), TOKENIZER).count() == 0


def test_differencing():
    assert sorted(sum((4, 5, 6, 7, 8)[i] for i in g) for g in packing.difference([4, 5, 6, 7, 8], 2)) == [14, 16]
    windows = packing.windows_of([600, 600, 600], 1024, cuts=False)
    assert len(windows) == 3                                     # two would be enough by size, but none holds two of them
    assert sum(b - a for w in packing.windows_of([600, 600, 600], 1024) for _, a, b in w) == 1800


def test_token_files(spark, docs, ids):
    path = scratch(spark)
    tokenfiles.write(docs, path, TOKENIZER)
    got = tokenfiles.read(spark, path).orderBy("start").collect()
    order = [5, 0, 1, 2, 3, 4, 6]
    assert [r.doc_id for r in got] == [DOCS[k][0] for k in order]
    assert [bytes(r.ids) for r in got] == [ids[k].tobytes() for k in order]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([len(ids[k]) for k in order])[:-1]]).tolist()
    assert [x.tolist() for x in tokenfiles.read_document(spark, path, 7)] == [ids[6].tolist()]
    with pytest.raises(ValueError):
        tokenfiles.BlockReader(bytes(spark.read.parquet(f"{path}/blocks").first().payload), b"other")
    path = scratch(spark)
    tokenfiles.write(empty(spark), path, TOKENIZER)
    assert tokenfiles.read(spark, path).count() == 0


def test_language(spark, docs):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the river ", "en"), ("das haus und der fluss ", "de")] * 10)]
    model = langid.train(spark.createDataFrame([(i, t * 5, lang) for i, t, lang in rows] + [(99, "null language", None)], "doc_id long, text string, lang string"))
    got = {r.text: r for r in langid.predict(spark.createDataFrame([(1, "the river and a house"), (2, "der fluss"), (3, "12 !"), (4, None), (5, "日本")], "doc_id long, text string"),
                                             model).join(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "doc_id long, text string"), "doc_id").collect()}
    assert [got[k].lang_pred for k in "abcd"] == ["en", "de", "und", "und"] and got["e"].lang_pred in ("en", "de")
    assert got["a"].score > 0.9 and got["d"].score == 0
    assert model.langs == ["de", "en"] and np.allclose(np.exp2(-model.table.reshape(-1, model.size, 2).astype(float)).sum(1), 1, atol=1e-4)     # every context codes all symbols
    assert langid.train(empty(spark)) is None and langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0
    assert langid.known(docs, model).columns == docs.columns


def test_quality(spark, docs):
    rnd = random.Random(2)
    good = [" ".join(rnd.choice(["river", "house", "old", "tree", "walks", "slowly"]) for _ in range(30)) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in good]
    texts = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120) if i % 3] + [(None, 1), (5, None)], "doc_id long, label int")
    model = quality.train(texts, labels)
    scores = dict(quality.score(texts, model).collect())
    assert all((scores[i] > 0.5) == (i < 60) for i in range(120))
    assert all(0 <= s <= 1 for _, s in quality.score(docs, model).collect())
    none = quality.train(empty(spark), labels)
    assert {s for _, s in quality.score(docs, none).collect()} == {0.5}


def edit(item: bytes, text: bytes) -> int:
    """Least edit distance to any part."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        last, row = row, [i + 1]
        for j, b in enumerate(text):
            row.append(min(last[j] + (a != b), last[j + 1] + 1, row[j] + 1))
    return min(row)


def test_decontamination(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    items = [(i, text(rnd.randint(20, 90))) for i in range(12)] + [(50, None), (51, " "), (52, "abc")]
    docs = []
    for i in range(80):
        part = list(rnd.choice(items[:12])[1])
        for _ in range(rnd.randint(0, 9)):
            k = rnd.randrange(len(part))
            part[k:k + rnd.randint(0, 1)] = rnd.choice(["x", "", "A", "  "])
        docs.append((i, text(40) + "".join(part) + text(30)))
    docs += [(90, None), (91, ""), (0, docs[0][1])]
    got = decontaminate.matches(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, r.item_id, r.distance) for r in got.collect())
    want = Counter()
    for i, t in docs:
        plain = decontaminate.plain(f"|{t or ''}|")[1:-1]
        for j, item in items:
            p = decontaminate.plain(item or "")
            if p and (d := edit(p, plain)) <= len(p) // decontaminate.ERROR_SPAN:
                want[i, j, d] += 1
    assert got == want
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.clean(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _, _ in want}
    assert decontaminate.matches(empty(spark), benchmark).count() == 0


def test_main_text():
    page = ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class='site-ad'>Buy a long thing now</div>"
            "<article><h1>A &amp; B</h1><p>One <b>two</b>&nbsp;three<br>four<p>Five</p><aside>no</aside><form>no<input></form><div id=comments><p>no</p></div><p>e<i>n</i>d</p></article>"
            "<footer>&copy;</footer><script>var t='</p>'</script>")
    assert htmltext.main_text(page) == "A & B One two three four Five end"
    plain = "<ul><li><a>Home</a></li><li><a>More</a></li></ul>" + "".join(f"<p>{'word ' * 30}{k}</p>" for k in range(3)) + "<div></div>"
    assert htmltext.main_text(plain) == " ".join("word " * 30 + str(k) for k in range(3)).replace("  ", " ")
    assert htmltext.main_text("") == "" and htmltext.main_text("<p>short") == "short" and htmltext.main_text("<article>a<p>b <img src='x") == "a b"


def test_main_text_keeps_short_lines_and_bodies_outside_articles():
    body = "word " * 100
    page = f"<ul><li><a href=x>Home</a></ul><h1>Title</h1><p>By A<div class=ad>Buy</div><p>{body}</p><div class=ad>Buy</div><p>Short closing line.</p><ul><li><a href=x>More</a></ul>"
    assert htmltext.main_text(page) == f"Title By A {body}Short closing line."
    cards = "".join(f"<article><h3>Teaser {k}</h3></article>" for k in range(3))
    got = htmltext.main_text(f"<div><p>{body}</p><p>{body}</p></div>{cards}")
    assert got.startswith(f"{body}{body}".strip())
    assert htmltext.main_text(f"<div>Site</div><article><p>{body}</p></article>") == body.strip()


def test_main_text_table(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (1, "u", "<p>x</p>", 5), (None, None, "", 5)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in htmltext.extract(pages).collect()) == ["", "", "x"]


def test_merge_of_runs():
    rnd = random.Random(4)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 30))) for _ in range(5)]
    got = list(suffixes.merged([suffixes.decoded(*suffixes.front_coded(r)) for r in runs]))
    want = sorted(x for r in runs for x in r)
    assert [x for _, x, _ in got] == want and [k for _, _, k in got] == suffixes.prefixes(want).tolist()


@pytest.mark.parametrize("length, span, most", [(20, 8, 50_000), (20, 16, 3)])
def test_repeats(spark, length, span, most):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(5, 60))) for _ in range(6)]
    docs = [(i, "".join(rnd.choice(base)[rnd.randint(0, 4):rnd.randint(8, 60)] if rnd.random() < 0.7 else "".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 12)))
                        for _ in range(rnd.randint(0, 6)))) for i in range(50)]
    docs += [(100, docs[3][1]), (101, ""), (102, "a" * 50), (103, None), (3, docs[3][1]), (None, "ab" * 40)]
    seen = Counter(t.encode()[i:i + length] for _, t in docs if t for i in range(len(t.encode()) - length + 1))
    want = []
    for d, t in docs:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want.append((d, len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    df = spark.createDataFrame([(*d, b"x") for d in docs], "doc_id long, text string, th binary").repartition(4)
    got = repeats.remove(df, length, span=span, most=most, bucket_items=40).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert repeats.remove(empty(spark), length, span=span).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 62, 200).astype(np.uint64)
    b = np.concatenate([a[:150], rng.integers(1, 1 << 62, 50).astype(np.uint64)])
    wa = rng.integers(1, 5, 200).astype(float)
    wb = np.concatenate([wa[:150] * 1.5, np.ones(50)])
    x, y = dict(zip(a, wa)), dict(zip(b, wb))
    keys = x.keys() | y.keys()
    want = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
    s = neardup.signatures(np.repeat([0, 1], 200), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, k=3000)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


@pytest.mark.parametrize("counted", [False, True])
def test_near_duplicates(spark, counted):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randint(40, 120))] for _ in range(8)]
    docs = []
    for i in range(150):
        t = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 5)):
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        docs.append((i, " ".join(t)))
    docs += [(200, "A b"), (201, "a B"), (202, ""), (203, None), (5, docs[5][1]), (None, docs[5][1]), (204, docs[7][1])]
    sets = [Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] * bool(w)) for w in ((t or "").lower().split() for _, t in docs)]
    if not counted:
        sets = [Counter(set(s)) for s in sets]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            union = (sets[i] | sets[j]).total()
            if (docs[i][1] or "") == (docs[j][1] or "") or union and (sets[i] & sets[j]).total() >= 0.8 * union:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), 1 << 60), (1 << 60) if d is None else d)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, th string")
    got = neardup.classes(df, counted=counted).toPandas()
    assert sorted(got.class_id.tolist()) == sorted(least[find(i)] for i in range(len(docs)))
    assert got.kept.sum() == len(least) == neardup.keep_one(df).count()
    assert neardup.classes(empty(spark)).count() == 0


def test_arrow_slices():
    from mailquarry.llm.arrays import slices
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "c"])], ["text"])
    assert [b.num_rows for b in slices(batch, limit=20)] == [2, 1, 2]
