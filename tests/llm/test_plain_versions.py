"""Language codes, quality scores, URL rules and main texts against plain versions."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa

from mailquarry.llm import htmltext, langid, quality, urlrules
from mailquarry.llm.arrays import utf8


def flat(texts):
    return utf8(pa.array(texts, pa.string()))


def test_code_lengths_against_a_plain_coder():
    """Prediction by partial matching written out: longest known context first, escapes with exclusion, then shorter ones."""
    rnd = random.Random(1)
    words = {"x": ["the", "then", "éa", "abra"], "y": ["den", "der", "abc", "ñu"]}
    texts = [(k, " ".join(rnd.choice(words[k]) for _ in range(12))) for k in words for _ in range(15)]
    rows = Counter()
    for k, t in texts:
        for g in langid.grams(*flat([t])).tolist():
            rows[k, g] += 1
    model = langid.fit(pd.DataFrame([(k, g, n) for (k, g), n in rows.items()], columns=["lang", "gram", "n"]))
    seen = {k: [defaultdict(Counter) for _ in range(4)] for k in words}
    for (k, g), n in rows.items():
        s = [(g >> (8 * j)) & 255 for j in (3, 2, 1, 0)]
        for order in range(4):
            seen[k][order][tuple(s[3 - order:3])][s[3]] += n
    symbols = {g & 255 for _, g in rows} | {0}
    size = len(symbols) + 1
    deep = {c for k in words for c, n in seen[k][3].items() if n.total() >= langid.MIN_CONTEXT}

    def probability(k, context, s, order):
        if order < 0:
            return 1 / size
        counts = seen[k][order].get(context[3 - order:], Counter()) if order < 3 or context in deep else Counter()
        if not counts:
            return probability(k, context, s, order - 1)
        if counts[s]:
            return counts[s] / (counts.total() + (len(counts) if len(counts) < size else 0))
        left = 1 - sum(probability(k, context, c, order - 1) for c in counts)
        return len(counts) / (counts.total() + len(counts)) * probability(k, context, s, order - 1) / left

    known = lambda c: c if c in symbols else -1
    for text in ["then abra", "der abc ñu", "Zq é", "x", "abrabra the"]:
        bits = langid.code_lengths(model, *flat([text]))[0]
        s, _ = langid.symbols(*flat([text]))
        s = [known(c) for c in s.tolist()]
        for j, k in enumerate(model.langs):
            want = sum(-math.log2(probability(k, tuple(s[i - 3:i]), s[i], 3)) for i in range(3, len(s)))
            assert math.isclose(bits[j], want, rel_tol=1e-4), (text, k)


def test_hinge_loss_against_projected_gradient():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, rng.integers(2, 9), replace=False)) for _ in range(60)]
    values = [rng.normal(size=len(r)) for r in rows]
    sign = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    cost = np.where(sign > 0, 0.8, 0.5)
    w = quality.descend(rows, values, sign, cost)
    x = np.zeros((60, 41))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r], x[i, 40] = v, 1
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha = np.zeros(60)
    for _ in range(20_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    best = (alpha * sign) @ x
    loss = lambda u: u @ u / 2 + (cost * np.maximum(0, 1 - sign * (x @ u))).sum()
    got = np.append(w[:40], w[-1])
    assert loss(got) <= loss(best) * 1.01 and not w[40:-1].any()


def test_scores_text_by_text():
    """Ratios, lengths, margin and curve of every text alone, from its buckets."""
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=quality.BUCKETS), rng.normal(size=quality.BUCKETS + 1), 0.7, -0.2)
    texts = ["", "one", "The old house, the old river!", "word " * 500, "é ü 1 2 3"]
    together = model.score(*flat(texts))
    for text, got in zip(texts, together.tolist(), strict=True):
        _, bucket = quality.features(*flat([text]))
        own = sorted(set(bucket.tolist()))
        length = math.sqrt(sum(model.ratio[b] ** 2 for b in own)) or 1
        margin = sum(model.ratio[b] / length * model.weight[b] for b in own) + model.weight[-1]
        assert math.isclose(got, 1 / (1 + math.exp(-(0.7 * margin - 0.2))), rel_tol=1e-9)
    assert np.allclose(quality.ratios(np.array([3.0, 0]), np.array([1.0, 4])), [math.log((2 / 7) / (4 / 5)), math.log((5 / 7) / (1 / 5))]) or quality.SMOOTH != 1


def test_url_rules_against_all_token_sets(spark):
    """Every subset of a url's tokens is tried as a rule."""
    rnd = random.Random(4)
    url = lambda: f"http://{rnd.choice(['a', 'b', 'www'])}.{rnd.choice(['x.com', 'y.net', 'Z.org'])}/{rnd.choice(['p', 'q'])}/{rnd.choice(['sale', 'news', '7'])}{rnd.choice(['', '?id=1', '?id=2&u=3'])}"
    labelled = [(u, "block" if ("sale" in u) != (rnd.random() < 0.1) else rnd.choice(["allow", "allow", "block"])) for u in (url() for _ in range(80))]
    pages = [(i, url()) for i in range(60)] + [(99, None), (98, "no scheme")]
    rules = [urlrules.Rule("y.net", "/q/", "block"), urlrules.Rule("net", "/", "allow")]
    parsed = spark.createDataFrame([*labelled, *((u, None) for _, u in pages)], "url string, verdict string").select("url", "verdict", urlrules.host().alias("host"), urlrules.path().alias("path"))
    token = {r.url: frozenset(r.tokens) for r in parsed.withColumn("tokens", urlrules.tokens()).collect()}
    least, sure = 0.1, 0.7
    baskets = [(token[u], v) for u, v in labelled]

    def want(u):
        u_host, u_path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1].split("#")[0].split("?")[0]
            u_host, _, u_path = rest.partition("/")
            u_host, u_path = u_host.lower(), "/" + u_path if "/" in rest else ""
        fits = [r for r in rules if (u_host == r.host or u_host.endswith("." + r.host)) and u_path.startswith(r.path)]
        if fits:
            best = max(fits, key=lambda r: len(r.text))
            return best.text, best.verdict
        found = []
        for k in range(1, len(token[u]) + 1):
            for items in combinations(sorted(token[u]), k):
                have = [v for t, v in baskets if t.issuperset(items)]
                for verdict in ("allow", "block"):
                    n = have.count(verdict)
                    if n and n >= math.ceil(least * len(baskets)) and n / len(have) >= sure:
                        found.append((n / len(have), n / len(baskets), k, verdict))
        return None, max(found)[3] if found else urlrules.DEFAULT

    df = spark.createDataFrame(pages, "page_id long, url string")
    got = urlrules.judge(df, rules, spark.createDataFrame(labelled, "url string, verdict string"), least, sure).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {i: want(u) for i, u in pages}
    assert {v for _, v in map(want, (u for _, u in pages))} == {"allow", "block"}


def test_main_text_of_generated_pages():
    """Pages put together from an article and everything else; what belongs to the article is known."""
    rnd = random.Random(5)
    words = lambda n: " ".join(rnd.choice(["river", "Haus", "été", "a", "&amp;", "&lt;b&gt;", "niño"]) for _ in range(n))
    plain = lambda t: t.replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    noise = [lambda: f"<nav><ul><li><a href=x>{words(2)}<li><a href='y'>{words(1)}</ul></nav>", lambda: f"<div class=ad>{words(4)}</div>", lambda: f"<aside><p>{words(5)}</aside>",
             lambda: f"<form action=z><p>{words(3)}<input></form>", lambda: f"<script>var a='<p>{words(3)}</p>'</script>", lambda: f"<style>p{{}}</style><!-- <p>{words(2)}</p> -->",
             lambda: f"<div class='x comments'><p>{words(6)}<p>{words(4)}</div>", lambda: f"<div class=cookie-banner>{words(3)}<button>{words(1)}</button></div>"]
    for _ in range(120):
        blocks = [words(rnd.randint(1, 60)) for _ in range(rnd.randint(3, 9))] + [words(60)]
        rnd.shuffle(blocks)
        body = ""
        for i, b in enumerate(blocks):
            kind = rnd.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}</ul>", "<table><tr><td>{}</table>", "<blockquote title='a>b'>{}</blockquote>"])
            inner = b.replace("river", "ri<b>ver</b>", 1) if rnd.random() < 0.5 else b
            body += kind.format(inner) + (rnd.choice(noise)() if i and rnd.random() < 0.3 else "")
        shell = rnd.choice(["<article class='post comments-open'>{}</article>", "<main>{}</main>", "<div class='content with-sidebar'>{}</div>", "<section id=alert-systems>{}</section>"])
        page = f"<!DOCTYPE html><html><head><title>{words(3)}</title></head><body><header>{words(3)}</header>{noise[0]()}{shell.format(body)}<footer>{words(5)}</footer></body></html>"
        assert htmltext.main_text(page) == plain(" ".join(blocks)), page


def test_main_text_of_deep_and_long_pages():
    assert htmltext.main_text("<div>" * 20_000 + "deep" + "</span></i>" * 20_000) == "deep"
    assert htmltext.main_text("<p>word " * 50_000) == " ".join(["word"] * 50_000)
    assert htmltext.main_text("<a " + "x='1' " * 20_000) == "" and htmltext.main_text("<b" * 20_000) == ""
