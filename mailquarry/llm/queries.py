"""Registered queries of the subpackage, and their DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.llm import codes, decontaminate, exact, htmltext, langid, neardup, packing, quality, repeats, setjoin, tokenfiles, urlrules, whitening
from mailquarry.llm.arrays import small_batches
from mailquarry.plans.staging import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its oracle if there is one."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_repeated_bytes(spark, sf_dir):
    """What remains of every document without repeated strings of 400 bytes."""
    return repeats.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def remainder(column: str, divisor: int) -> Column:
    """CRC-32 of an id as text, modulo the divisor; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


@query("""SELECT doc_id, max(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY sha) AS kept, sha AS text_sha256
  FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS sha FROM documents)""")
def op1_exact_dedup(spark, sf_dir):
    """Group and keeper of every document."""
    return exact.dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op3_quality(spark, sf_dir):
    """Score and class of every document."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(remainder("doc_id", 5) != 0)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op4_packing(spark, sf_dir):
    """Every piece of every packed document."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op5_decontamination(spark, sf_dir):
    """Every document and benchmark item that it holds, with the edit distance."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


RULES = [urlrules.Rule("com", "/", "allow"), urlrules.Rule("example.com", "/en/", "block"), urlrules.Rule("www.example.com", "/en/", "allow"),
         urlrules.Rule("net", "/es/", "block"), urlrules.Rule("net", "/fr/", "block")]


@query()
def op6_url_rules(spark, sf_dir):
    """Verdict on the URL of every page. The number in a path is the document that the page shows; its labels are those of the URL."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = pages.select("url", F.regexp_extract(urlrules.path(), "/([0-9]{1,18})", 1).try_cast("long").alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow")
    labelled = shown.join(labels, "doc_id").select("url", bad.alias("verdict"))
    return urlrules.judge(pages, RULES, labelled).select("page_id", "host", "path", "rule", "verdict")


@query(f"""SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages) p
  LEFT JOIN (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.text}', '{r.verdict}')" for r in RULES)}) r(h, start, rule, verdict)
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY page_id, host, path""")
def url_rules_fixed(spark, sf_dir):
    """The part of op6 that stated rules decide: host, path, rule and verdict of every page; null where no rule fits."""
    rule, verdict = urlrules.fixed(RULES)
    parsed = table(spark, sf_dir, "pages").select("page_id", urlrules.host().alias("host"), urlrules.path().alias("path"))
    return parsed.select("*", rule.alias("rule"), verdict.alias("verdict"))


@query()
def op7_main_text(spark, sf_dir):
    """Main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op8_near_duplicates(spark, sf_dir):
    """Class of near-duplicates of every document; a run of words weighs as often as it occurs."""
    return neardup.classes(table(spark, sf_dir, "documents"), counted=True).select("doc_id", "class_id", "class_size", "kept")


@query()
def op9_language(spark, sf_dir):
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs.where(remainder("doc_id", 4) != 2)))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query()
def op10_token_files(spark, sf_dir):
    """Every document as read back from the written dataset."""
    path = scratch(spark)
    tokenfiles.write(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return tokenfiles.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(r"""WITH RECURSIVE split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM split),
single AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS e FROM sets),
pairs AS (SELECT x.r AS a, y.r AS b, any_value(x.n + y.n) AS total, count(*) AS shared FROM single x JOIN single y ON x.e = y.e AND x.r <> y.r GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (total - shared)),
walk AS (SELECT r AS a, r AS b FROM sets UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id FROM walk JOIN sets s ON walk.a = s.r JOIN sets o ON walk.b = o.r GROUP BY s.r, s.doc_id, s.s""")
def op11_set_join(spark, sf_dir):
    """Component of every document under links of similar shingle sets."""
    return setjoin.classes(table(spark, sf_dir, "documents"))


def _codebook_rounds(parts: int, entries: int, rounds: int) -> str:
    """Rounds of assignment and averaging as common table expressions, ``a{r}`` and ``b{r}``."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, label, p, any_value(v.x) AS x, min(CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.x, b.x)]) AS BIGINT) * {entries} + b.e) AS k
  FROM parts v JOIN b{r} b USING (p) GROUP BY vec_id, label, p)""")
        if r < rounds:
            out.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
    SELECT p, k % {entries} AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, len(x) + 1) t(i) GROUP BY ALL) GROUP BY p, e) m USING (p, e))""")
    return ",\n".join(out)


@query(f"""WITH kept AS (SELECT vec_id, label, [CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum([CASE WHEN c IS NULL OR NOT isfinite(c) THEN 1 ELSE 0 END FOR c IN embedding]) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(4) t(p)),
b0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts) WHERE e < 256),
{_codebook_rounds(codes.PARTS, codes.ENTRIES, codes.ROUNDS)},
coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', k % 256), '' ORDER BY p) AS code, CAST(sum(k // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY p, e, i)) FROM b4, range(1, len(x) + 1) t(i)) AS codebooks_sha256 FROM coded""")
def op12_vector_codes(spark, sf_dir):
    """Code of every vector, and the errors of the codes."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


@query()
def op13_whitening(spark, sf_dir):
    """The first 32 whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
