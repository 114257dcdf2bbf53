"""Every registered query: a Spark function and, where SQL can say it, a DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import net, rows
from mailquarry.functions import text as X
from mailquarry.operators import (attribute, clean, corpus, embedding, evaluate, features, findings, headers, html, indicators, learn, mail, mime, quarantine, reputation,
                                  sparse, techniques, text, trees, unwrap, urls, variants, verdict)
from mailquarry.operators.outlier import OutlierForest, minmax_scale
from mailquarry.plans import fixtures as fx
from mailquarry.plans import lookups, registry, scoring, vectors as stored_vectors
from mailquarry.plans import oracles as o
from mailquarry.plans.staging import scratch, written
from mailquarry.sinks import exports
from mailquarry.sources import corpora

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
STAMP = "2024-06-01T00:00:00Z"
PRIORITY = {"chat": 1, "bench": 2, "src3": 3}


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register a query under its function name, with its oracle if there is one."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = o.with_ctes(sql, *ctes)
        return fn

    return register


# --- shared inputs ------------------------------------------------------------------------

def parsed(spark: SparkSession, d: str) -> DataFrame:
    return mail.parse_mail(fx.mail_raw(spark, d))


def mail_table(spark: SparkSession, d: str) -> DataFrame:
    """Parsed mails, written once because several branches of a query read them."""
    return written(parsed(spark, d))


def curated(spark: SparkSession, d: str) -> DataFrame:
    df = clean.drop_blank(fx.corpus(spark, d)).withColumn("label", clean.label_strict(F.col("label")))
    return df.where("label IS NOT NULL")


def deduped(spark: SparkSession, d: str) -> DataFrame:
    return corpus.drop_near_duplicates(curated(spark, d), PRIORITY)


def links(spark: SparkSession, d: str) -> DataFrame:
    return mail.link_rows(parsed(spark, d))


def distinct_links(spark: SparkSession, d: str) -> DataFrame:
    return urls.distinct_urls(links(spark, d))


def snapshot(spark: SparkSession, sql: str, src: DataFrame) -> DataFrame:
    return spark.sql(sql, src=src)


def named_domains(df: DataFrame) -> DataFrame:
    """The registered domains of links that have one, a row per link; the test is on a generated column, so it repeats no derivation."""
    return rows.explode_values(urls.registered_domains(df), [], F.array(F.nullif("domain", F.lit(""))), "domain")


def link_domains(df: DataFrame) -> DataFrame:
    return named_domains(df).distinct()


def snapshots(spark: SparkSession, p: DataFrame) -> scoring.Snapshots:
    du = urls.distinct_urls(mail.link_rows(p))
    dd = link_domains(du)
    s = lambda sql, src: snapshot(spark, sql, src)
    keys = scoring.fraud_keys(p).select("kind", F.col("key").alias("item")).distinct()
    return scoring.Snapshots(
        s(lookups.URL_REP, du), s(lookups.BLOCKLIST, du), s(lookups.URL_SCAN, du), s(lookups.MALWARE_URLS, du),
        s(lookups.IP_REP, reputation.sender_ips(p).select("ip").distinct()), s(lookups.FRAUD_REP, keys),
        s(lookups.WHOIS, dd), s(lookups.CERT_LOG, dd), s(lookups.AI_ANSWER, p.select("mail_id")), lookups.AS_OF)


def full_features(spark: SparkSession, d: str) -> DataFrame:
    p = mail_table(spark, d)
    return scoring.feature_table(p, snapshots(spark, p))


FIXED_FEATURES = ("url_tld_risk_score_max", "hdr_from_reply_to_mismatch", "hdr_spf_result", "txt_urgency_phrase_count")


def fixed_probability() -> Column:
    """Logistic score with fixed weights, in place of a trained model."""
    z = (-1.2 + 1.1 * F.col("url_tld_risk_score_max") + 0.8 * F.col("hdr_from_reply_to_mismatch") - 0.6 * F.col("hdr_spf_result")
         + 0.3 * F.col("txt_urgency_phrase_count"))
    return F.round(1 / (1 + F.exp(-z)), 4)


def scored_mails(spark: SparkSession, d: str) -> DataFrame:
    return snapshot(spark, lookups.SCORED, fx.table(spark, d, "documents"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def r6(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in cols)


# --- sources ------------------------------------------------------------------------------

_MD5_OUT = "SELECT label::INT AS label, source, count(*) AS n, count(DISTINCT h) AS n_distinct, min(h) AS first_hash, max(h) AS last_hash FROM ({}) GROUP BY ALL"


def _digest(df: DataFrame) -> DataFrame:
    h = F.md5(X.strip(F.col("raw_email")))
    return df.groupBy("label", "source").agg(F.count("*").alias("n"), F.countDistinct(h).alias("n_distinct"), F.min(h).alias("first_hash"), F.max(h).alias("last_hash"))


@query(_MD5_OUT.format(f"SELECT label, 'csv' AS source, md5({o.strip('raw_email')}) AS h FROM curated"), "curated")
def src_csv_corpus(spark, d):
    out = scratch(spark)
    fx.corpus(spark, d).select(F.col("label").alias(" Category"), F.col("raw_email").alias("Message ")).write.csv(
        out, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _digest(corpora.csv_corpus(spark, [out + "-missing", out], "csv"))


@query(_MD5_OUT.format(f"SELECT 1 AS label, 'files' AS source, md5({o.strip('text')}) AS h FROM benchmark"))
def src_mail_files(spark, d):
    out = scratch(spark)
    fx.table(spark, d, "benchmark").select(F.col("item_id").alias("n"), "text").write.partitionBy("n").text(out)
    return _digest(corpora.mail_folder(spark, f"{out}/n=*", 1, "files"))


@query(_MD5_OUT.format(f"SELECT 0 AS label, 'mbox' AS source, md5({o.strip("replace(chr(10) || text, chr(10) || 'From ', chr(10) || '>From ')")}) AS h FROM documents"))
def src_mbox(spark, d):
    out = scratch(spark)
    quoted = F.replace(F.concat(F.lit("\n"), "text"), F.lit("\nFrom "), F.lit("\n>From "))      # as mbox writers do
    fx.table(spark, d, "documents").select(F.concat(F.lit("From daemon Mon Jun  3 10:00:00 2024"), quoted, F.lit("\n")).alias("value")).write.text(out)
    return _digest(corpora.mbox(spark, out, 0, "mbox"))


@query(_MD5_OUT.format(f"SELECT (item_id % 2)::INT AS label, 'folders' AS source, md5({o.strip('text')}) AS h FROM benchmark"))
def src_ham_spam(spark, d):
    """Folders with one mail per file, one folder per label."""
    out = scratch(spark)
    items = fx.table(spark, d, "benchmark").select((F.col("item_id") % 2).alias("y"), F.col("item_id").alias("n"), "text")
    items.write.partitionBy("y", "n").text(out)
    return _digest(corpora.ham_and_spam(spark, [f"{out}/y=0"], [f"{out}/y=1"], "folders"))


@query(_MD5_OUT.format(f"SELECT label, 'pq' AS source, md5({o.strip('raw_email')}) AS h FROM curated"), "curated")
def src_parquet_corpus(spark, d):
    """Columnar corpus whose column names differ in case and blanks from the usual ones."""
    out = scratch(spark)
    fx.corpus(spark, d).select(F.col("label").alias("Class "), F.col("raw_email").alias(" BODY")).write.parquet(out)
    return _digest(corpora.parquet_corpus(spark, [out + "-missing", out], "pq"))


@query(_MD5_OUT.format(f"SELECT 1 AS label, 'unlabelled' AS source, md5({o.strip('text')}) AS h FROM documents WHERE {o.strip('text')} <> ''"))
def src_optional_label(spark, d):
    """A corpus without a label column, its text column found by a part of the name."""
    df = fx.table(spark, d, "documents").select("doc_id", F.col("text").alias("original_message_part"))
    return _digest(clean.to_corpus(df, "unlabelled", substring=True, label_if_missing=1))


@query(_MD5_OUT.format(f"SELECT label, 'processed' AS source, md5({o.strip('raw_email')}) AS h FROM curated"), "curated")
def src_prepared(spark, d):
    """A corpus written earlier, without a source column."""
    out = scratch(spark)
    curated(spark, d).select("label", "raw_email").write.parquet(out)
    return _digest(corpora.prepared_corpus(spark, out))


@query(f"SELECT doc_id, i - 1 AS chunk_no, md5(c) AS chunk_md5, length(c) AS n_chars FROM (SELECT doc_id, {o.strip('c')} AS c, i FROM ("
       "SELECT doc_id, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text || chr(10) || chr(10) || html_tail, chr(10) || chr(10)) AS x FROM ("
       "SELECT doc_id, text, 'tail ' || text AS html_tail FROM documents)))) WHERE length(c) >= 50")
def src_blob_chunks(spark, d):
    df = fx.table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n\ntail "), "text").alias("text"))
    c = corpora.blob_chunks(df, "text")
    return c.select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"), F.length("chunk").alias("n_chars"))


@query("SELECT 'documents' AS src, doc_id AS id, 1 AS label, md5(text) AS h FROM documents WHERE trim(text) <> '' UNION ALL "
       "SELECT 'conversations', conv_id * 1000 + turn, CASE role WHEN 'user' THEN 1 WHEN 'safe' THEN 0 ELSE 1 END, md5(text) FROM conversations WHERE trim(text) <> ''")
def union_hetero(spark, d):
    a = fx.table(spark, d, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.lit(1).alias("label"), "text")
    role = F.coalesce(F.when(F.col("role") == "user", F.lit(1)).when(F.col("role") == "safe", F.lit(0)), F.lit(1))
    b = fx.table(spark, d, "conversations").select(F.lit("conversations").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), role.alias("label"), "text")
    return clean.drop_blank(corpus.union_corpora(a, None, b), "text").select("src", "id", "label", F.md5("text").alias("h"))


@query(f"SELECT domain, count(*) AS n_links FROM (SELECT domain FROM mail_url JOIN url_dom USING (url) WHERE domain <> '') x WHERE domain NOT IN ({lookups.ALLOWLIST.format(src='dd')}) GROUP BY domain",
       "mail_url", "url_dom", "dd")
def domain_allowlist(spark, d):
    counts = named_domains(mail.link_rows(mail_table(spark, d))).groupBy("domain").agg(F.count("*").alias("n_links"))        # combined before the shuffle: one row per domain meets the list
    return corpora.not_in_allowlist(counts, snapshot(spark, lookups.ALLOWLIST, counts.select("domain")))


# --- projection and cleaning --------------------------------------------------------------

@query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def column_discovery(spark, d):
    df = fx.table(spark, d, "documents").withColumnsRenamed({"text": " Email_Text ", "source": "SOURCE"})
    found = clean.find_column(df.columns, L.TEXT_COLUMNS)
    return df.groupBy(F.col(clean.find_column(df.columns, ["source"])).alias("source")).agg(F.count("*").alias("n"), F.sum(F.length(F.col(f"`{found}`"))).alias("chars"))


@query(f"SELECT source, count(*) AS n FROM corpus WHERE {o.strip('coalesce(raw_email, chr(32))')} <> '' GROUP BY source", "corpus")
def drop_blank(spark, d):
    return clean.drop_blank(fx.corpus(spark, d)).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT mail_id, label::INT AS label FROM labelled WHERE label IS NOT NULL", "labelled")
def label_normalise(spark, d):
    df = fx.corpus(spark, d).withColumn("label", clean.label_strict(F.col("label")))
    return clean.binary_only(df).select("mail_id", "label")


@query("SELECT doc_id, CASE WHEN v IN ('0', 'ham') THEN 0 WHEN v IN ('1', '2', 'phish', 'spam') THEN 1 END::INT AS label FROM (SELECT doc_id, "
       "['0', 'ham', '1', '2', 'phish', 'spam', '7', 'odd'][(doc_id % 8 + 1)::INT] AS v FROM documents) WHERE v NOT IN ('7', 'odd')")
def label_three_class(spark, d):
    raw = F.element_at(F.array(*[F.lit(v) for v in ("0", " Ham", "1", "2", "PHISH", "spam", "7", "odd")]), (F.col("doc_id") % 8 + 1).cast("int"))
    return fx.table(spark, d, "documents").select("doc_id", clean.label_three_class(raw).alias("label")).where("label IS NOT NULL")


@query("SELECT doc_id, CASE WHEN v IN ('Phishing Email', '1', '1.0', '1.7', 'spam') THEN 1 ELSE 0 END::INT AS label FROM (SELECT doc_id, "
       "['Phishing Email', '1', '1.0', '0.0', '1.7', 'spam', 'ham', '2', 'what'][(doc_id % 9 + 1)::INT] AS v FROM documents)")
def label_lenient(spark, d):
    raw = F.element_at(F.array(*[F.lit(v) for v in ("Phishing Email", "1", "1.0", "0.0", "1.7", " spam", "ham", "2", "what")]), (F.col("doc_id") % 9 + 1).cast("int"))
    return fx.table(spark, d, "documents").select("doc_id", clean.label_lenient(raw).alias("label"))


@query(f"SELECT mail_id, length({o.strip('raw_email')}) AS n_chars FROM corpus WHERE length({o.strip('raw_email')}) >= 50", "corpus")
def min_length(spark, d):
    return clean.min_length(fx.corpus(spark, d), 50).select("mail_id", F.length(X.strip(F.col("raw_email"))).alias("n_chars"))


@query("SELECT doc_id, md5(substr(text, 1, 1000)) AS h, least(length(text), 1000) AS n_chars FROM documents")
def cap_text(spark, d):
    c = clean.cap_text(F.col("text"), 1000)
    return fx.table(spark, d, "documents").select("doc_id", F.md5(c).alias("h"), F.length(c).alias("n_chars"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2, 3) THEN 0.0 ELSE value END::DOUBLE AS value FROM events")
def nan_to_zero(spark, d):
    odd = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("inf"))) \
        .when(F.col("event_id") % 5 == 2, F.lit(float("-inf"))).when(F.col("event_id") % 5 == 4, F.col("value"))
    return fx.table(spark, d, "events").select("event_id", clean.zero_if_not_finite(odd).alias("value"))


@query(f"SELECT mail_id, md5({o.refang('body')}) AS h, contains({o.refang('body')}, 'hxxp') AS still_defanged FROM mail", "mail")
def refang_text(spark, d):
    """The decoded body of every mail."""
    body = parsed(spark, d).select("mail_id", X.refang(mail.body_choice()).alias("t"))
    return body.select("mail_id", F.md5("t").alias("h"), F.contains("t", F.lit("hxxp")).alias("still_defanged"))


# --- corpus -------------------------------------------------------------------------------

@query("SELECT source, count(*) AS n, sum(label)::BIGINT AS phishing FROM curated GROUP BY source", "curated")
def corpus_union(spark, d):
    df = curated(spark, d)
    parts = [df.where("mail_id < 1000000000"), None, df.where("mail_id >= 1000000000")]
    return corpus.union_corpora(*parts).groupBy("source").agg(F.count("*").alias("n"), F.sum("label").alias("phishing"))


@query("SELECT source, CASE source WHEN 'chat' THEN 1 WHEN 'bench' THEN 2 WHEN 'src3' THEN 3 ELSE 6 END AS priority, count(*) AS n FROM curated GROUP BY source", "curated")
def source_priority(spark, d):
    return curated(spark, d).groupBy("source", corpus.source_priority(F.col("source"), PRIORITY).alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT mail_id, label::INT AS label, source FROM deduped", "deduped")
def dedup_texts(spark, d):
    return deduped(spark, d).select("mail_id", "label", "source")


@query("SELECT mail_id, label::INT AS label, source FROM ranked200 WHERE rn = 1", "ranked200")
def dedup_prefix200(spark, d):
    return corpus.drop_near_duplicates(curated(spark, d), PRIORITY, L.DEDUP_PREFIX).select("mail_id", "label", "source")


@query("SELECT source, count(*) AS total, count_if(rn = 1)::BIGINT AS kept, count_if(rn > 1)::BIGINT AS removed FROM ranked GROUP BY source", "ranked")
def dedup_report(spark, d):
    return corpus.dedup_report(curated(spark, d), PRIORITY)


@query("SELECT mail_id, source FROM (SELECT mail_id, source, row_number() OVER (ORDER BY md5('42|' || mail_id)) AS rn FROM curated) WHERE rn <= 300", "curated")
def sample_cap(spark, d):
    return corpus.sample_exactly(curated(spark, d), 300).select("mail_id", "source")


@query("SELECT mail_id, md5('42|' || mail_id) AS order_key FROM curated", "curated")
def shuffle_stable(spark, d):
    return corpus.shuffled(curated(spark, d)).select("mail_id", corpus.order_hash(F.col("mail_id")).alias("order_key"))


_SPLIT = """SELECT mail_id, label::INT AS label, source, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || mail_id)) AS rn, count(*) OVER (PARTITION BY label) AS n FROM deduped)"""


@query(_SPLIT, "deduped")
def stratified_split(spark, d):
    return corpus.stratified_split(deduped(spark, d)).select("mail_id", "label", "source", "split")


@query(f"SELECT split, label, count(*) AS n, min(mail_id) AS first_id, max(mail_id) AS last_id FROM ({_SPLIT}) GROUP BY split, label", "deduped")
def split_files(spark, d):
    """Training and test part written as Parquet folders and read back."""
    out = scratch(spark)
    exports.write_split(corpus.stratified_split(deduped(spark, d)), out)
    return spark.read.parquet(out).groupBy("split", "label").agg(F.count("*").alias("n"), F.min("mail_id").alias("first_id"), F.max("mail_id").alias("last_id"))


@query("SELECT coalesce(source, 'ALL') AS source, count(*) AS total, count_if(label = 1)::BIGINT AS phishing, count_if(label = 0)::BIGINT AS legitimate, "
       "round(count_if(label = 1)::DOUBLE / greatest(count_if(label = 0), 1), 6) AS imbalance_ratio FROM deduped GROUP BY ROLLUP (source)", "deduped")
def class_balance(spark, d):
    return corpus.class_balance(deduped(spark, d))


@query("SELECT count(DISTINCT label) AS n_labels, count(DISTINCT label) >= 2 AS ok FROM curated", "curated")
def two_class_guard(spark, d):
    return corpus.two_class_guard(curated(spark, d))


@query("SELECT sha256(raw_email) AS sha256, count(*) AS copies, min(mail_id) AS first_id FROM curated GROUP BY 1", "curated")
def raw_fingerprint(spark, d):
    return corpus.raw_fingerprint(curated(spark, d))


@query(f"SELECT split, source, count(*) AS total, count_if(label = 1)::BIGINT AS phishing, count_if(label = 0)::BIGINT AS legitimate FROM ({_SPLIT}) GROUP BY split, source", "deduped")
def corpus_manifest(spark, d):
    return corpus.corpus_manifest(corpus.stratified_split(deduped(spark, d)))


# --- mail structure -----------------------------------------------------------------------

@query(f"SELECT mail_id, (i - 1)::INT AS pos, lower(split_part(l, ':', 1)) AS name, {o.strip(o.sub('l', '^[^:]*:', ''))} AS value FROM ("
       "SELECT mail_id, unnest(x) AS l, generate_subscripts(x, 1) AS i FROM (SELECT mail_id, string_split(head, chr(10)) AS x FROM mail_head)) WHERE contains(l, ':')", "mail_head")
def mail_headers(spark, d):
    return mail.header_rows(fx.mail_raw(spark, d))


_FIELDS = ["from_address", "to_address", "reply_to", "return_path", "subject", "date", "message_id", "x_mailer", "content_type", "auth_results", "received_spf_header",
           "x_originating_ip", "user_agent", "mime_version"]


@query(f"SELECT mail_id, {', '.join(_FIELDS)}, dkim_signed, length(head) AS head_chars FROM mail", "mail")
def mail_fields(spark, d):
    return mail.mail_fields(fx.mail_raw(spark, d)).select("mail_id", *_FIELDS, "dkim_signed", F.length("header_raw").alias("head_chars"))


# Encoded words in sets of one byte, of several bytes, and one that nobody knows.
_WORDS = [("=?windows-1252?Q?=80_caf=E9?=", "€ café"), ("=?koi8-r?B?8NLJ18XU?=", "Привет"), ("=?shift_jis?B?k/qWew==?=", "日本"), ("=?gb2312?B?1tC5+g==?=", "中国"),
          ("=?no-such-set?B?eA==?=", "=?no-such-set?B?eA==?="), ("end", "end")]


@query("SELECT doc_id AS mail_id, md5('Re: ' || text || ' and ' || CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {o.lit(t)}" for i, (_, t) in enumerate(_WORDS)) + " END) AS h FROM documents")
def encoded_words(spark, d):
    """Subjects with a word in UTF-8 and one in another character set."""
    other = F.element_at(F.array(*[F.lit(w) for w, _ in _WORDS]), (F.col("doc_id") % len(_WORDS) + 1).cast("int"))
    word = F.concat(F.lit("Subject: Re: =?UTF-8?B?"), F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit("")), F.lit("?= and "), other, F.lit("\n\nbody"))
    mails = mail.parse_mail(fx.table(spark, d, "documents").select(F.col("doc_id").alias("mail_id"), word.alias("raw_email")))
    return mails.select("mail_id", F.md5("subject").alias("h"))


@query(f"SELECT mail_id, pos::INT AS pos, {o.strip('received')} AS received FROM relay", "relay")
def relay_chain(spark, d):
    return mail.relay_chain(mail.mail_fields(fx.mail_raw(spark, d)))


@query("SELECT doc_id AS mail_id, 0 AS part_no, 'text/plain' AS mime, false AS is_attachment, '' AS filename, '' AS sha256, md5(text) AS content_md5 FROM documents UNION ALL "
       "SELECT doc_id, 1, 'text/html', false, '', '', md5('<p>' || text || '</p>') FROM documents UNION ALL "
       "SELECT doc_id, 2, 'application/octet-stream', true, 'f' || doc_id || '.bin', sha256(text), '' FROM documents")
def mail_parts(spark, d):
    empty = lambda c: F.coalesce(c, F.lit(""))
    return mime.part_rows(fx.mail_mime(spark, d)).select("mail_id", "part_no", "mime", "is_attachment", empty(F.col("filename")).alias("filename"),
                                                         empty(F.col("sha256")).alias("sha256"), empty(F.md5("content")).alias("content_md5"))


@query("SELECT doc_id AS mail_id, md5(text || chr(10)) AS text_md5, md5('<p>' || text || '</p>' || chr(10)) AS html_md5, 1 AS n_attachments, 'f' || doc_id || '.bin' AS filename, sha256(text) AS sha256 FROM documents")
def mail_bodies(spark, d):
    """Bodies and attachments of multipart mails, by the way that every job takes."""
    p = mail.parse_mail(fx.mail_mime(spark, d))
    file = F.get("attachments", F.lit(0))
    return p.select("mail_id", F.md5("body_text").alias("text_md5"), F.md5("body_html").alias("html_md5"), F.size("attachments").alias("n_attachments"),
                    file["filename"].alias("filename"), file["sha256"].alias("sha256"))


@query("SELECT mail_id, pos::INT AS pos, url FROM mail_url", "mail_url")
def mail_urls(spark, d):
    return links(spark, d)


@query("SELECT mail_id, ip FROM sender", "sender")
def sender_ip(spark, d):
    return reputation.sender_ips(mail.mail_fields(fx.mail_raw(spark, d)))


# --- header features ----------------------------------------------------------------------

_HDR = [f"hdr_{n}" for n in L.HEADER_FEATURES]


@query(f"SELECT mail_id, {', '.join(_HDR)} FROM hdr", "hdr")
def header_features(spark, d):
    return headers.header_features(parsed(spark, d))


@query("SELECT mail_id, kind, host FROM addr", "addr")
def address_domain(spark, d):
    m = mail.mail_fields(fx.mail_raw(spark, d))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(net.address_domain(F.col(k))).alias("host")) for k in ("from_address", "reply_to", "return_path")])
    return m.select("mail_id", F.inline(kinds))


@query("SELECT mail_id, received_hop_count AS hops, received_geo_anomaly AS diverse FROM geo", "geo")
def relay_diversity(spark, d):
    m = mail.mail_fields(fx.mail_raw(spark, d))
    return m.select("mail_id", F.size("received").alias("hops"), headers.relay_diversity(F.col("received")).alias("diverse"))


@query("SELECT mail_id, spf_result, dkim_result, dmarc_result FROM auth", "auth")
def auth_results(spark, d):
    m = mail.mail_fields(fx.mail_raw(spark, d))
    cols = headers.auth_columns(F.col("auth_results"), F.col("received_spf_header"), F.col("dkim_signed"))
    return m.select("mail_id", *[e.alias(n) for n, e in cols.items()])


_SENDERS = "(SELECT DISTINCT host AS domain FROM addr WHERE kind = 'from_address' AND host <> '')"
o.cte("dns_txt", lookups.DNS_TXT.format(src=_SENDERS), "addr")


@query(f"""SELECT domain, coalesce(max(CASE WHEN kind = 'spf' AND contains(lower(txt), 'v=spf1') THEN CASE WHEN contains(txt, '~all') OR contains(txt, '?all') THEN 0 ELSE 1 END END), -1) AS spf_policy,
    coalesce(max(CASE WHEN kind = 'dkim' AND selector IN ({o.values(L.DKIM_SELECTORS)}) THEN 1 END), -1) AS dkim_policy,
    coalesce(max(CASE WHEN kind = 'dmarc' AND contains(lower(txt), 'v=dmarc1') THEN CASE WHEN contains(lower(txt), 'p=reject') THEN 1 WHEN contains(lower(txt), 'p=quarantine') THEN 0 ELSE -1 END END), -1) AS dmarc_policy
  FROM {_SENDERS} s LEFT JOIN dns_txt USING (domain) GROUP BY domain""", "addr", "dns_txt")
def dns_policy_join(spark, d):
    m = mail.mail_fields(fx.mail_raw(spark, d))
    senders = rows.explode_values(written(m), [], F.array(F.lower(net.address_domain(F.col("from_address")))), "domain").where("domain <> ''").distinct()
    return headers.dns_policy(senders, snapshot(spark, lookups.DNS_TXT, senders))


# --- URLs ---------------------------------------------------------------------------------

@query(f"SELECT url, lower({o.ext('url', '^([A-Za-z][A-Za-z0-9+.-]*):', 1)}) AS scheme, {o.netloc('url')} AS netloc, {o.path('url')} AS path, {o.query_of('url')} AS query FROM du", "du")
def url_parts(spark, d):
    return urls.url_parts(distinct_links(spark, d))


@query("SELECT url, host, suffix, domain, subdomain FROM url_dom", "url_dom")
def registered_domain(spark, d):
    return urls.registered_domains(distinct_links(spark, d)).select("url", "host", "suffix", "domain", "subdomain")


_URL_DOUBLES = {"digit_ratio", "url_entropy", "tld_risk_score"}


@query(f"SELECT url, {r6(L.URL_FEATURES, _URL_DOUBLES)} FROM url_lex", "url_lex")
def url_lexical(spark, d):
    return rounded(urls.url_lexical(distinct_links(spark, d)))


@query("SELECT url, round(entropy, 6) AS entropy FROM url_ent", "url_ent")
def url_entropy(spark, d):
    return distinct_links(spark, d).select("url", F.round(X.entropy(F.col("url")), 6).alias("entropy"))


o.cte("page_dom", o.domains_of("pages", "page_id", o.netloc("url")))


@query(f"SELECT page_id, suffix, CASE WHEN suffix IN ({o.values(L.RISK_TLDS)}) THEN 1.0 WHEN suffix IN ({o.values(L.SAFE_TLDS)}) THEN 0.0 ELSE 0.5 END::DOUBLE AS tld_risk FROM page_dom", "page_dom")
def tld_risk(spark, d):
    df = net.run_stages(fx.table(spark, d, "pages").select("page_id", "url"), net.domain_stages())
    return df.select("page_id", "suffix", urls.tld_risk(F.col("suffix")).alias("tld_risk"))


_URL_MAIL = ["url_url_count"] + [f"url_{f}_{s}" for f in L.URL_FEATURES for s in ("max", "mean")]


@query(f"SELECT mail_id, {r6(_URL_MAIL, set(_URL_MAIL[1:]))} FROM url_feat", "url_feat")
def url_mail_agg(spark, d):
    return rounded(urls.url_features(parsed(spark, d)))


@query("SELECT mail_id, url_domain_age_days, url_domain_age_risk, url_registrar_risk FROM whois_mail", "whois_mail")
def whois_risk(spark, d):
    p = mail_table(spark, d)
    whois = snapshot(spark, lookups.WHOIS, link_domains(urls.distinct_urls(mail.link_rows(p))))
    return urls.worst_whois(urls.whois_risk(urls.mail_domains(p), whois, lookups.AS_OF))


@query("SELECT mail_id, url_cert_age_days, url_cert_lets_encrypt, url_cert_brand_mismatch FROM cert_mail", "cert_mail")
def cert_risk(spark, d):
    p = mail_table(spark, d)
    log = snapshot(spark, lookups.CERT_LOG, link_domains(urls.distinct_urls(mail.link_rows(p))))
    return urls.worst_cert(urls.cert_risk(urls.mail_domains(p), log, lookups.AS_OF))


@query("SELECT url, cur AS cleaned, method, wrapped AS was_wrapped FROM uw1", "uw1")
def url_unwrap(spark, d):
    return unwrap.single_pass(distinct_links(spark, d))


@query("SELECT url, cur AS cleaned, method, wrapped AS was_wrapped FROM uw6", "uw6")
def url_unwrap_deep(spark, d):
    return unwrap.clean_urls(distinct_links(spark, d))


_SHORT = f"(regexp_replace(lower({o.netloc('cur')}), '^www[.]', '') IN ({o.values(L.REDIRECT_HOSTS)}))"
_MIME = o.has("cur", "(?i)^https?://protect(?:-[a-z0-9]+)?[.]mimecast[.]com/s/")
_BARR = o.has("cur", "(?i)^https?://links[.]barracudanetworks[.]com/")
o.cte("redirect_one", f"SELECT url AS rurl, min(location) AS loc FROM redirect_map WHERE {o._target('location')} GROUP BY url", "redirect_map")
o.cte("rd0", o.CTES["uw0"][1], "du")
for _i in range(1, 7):
    o.cte(f"rx{_i}", f"""SELECT u.url, p.cur AS before, u.cur AS plain, u.method AS m, u.wrapped AS w, p.method AS pm, p.wrapped AS pw, loc,
        CASE WHEN {_MIME.replace("cur", "p.cur")} THEN '{L.METHOD_MIMECAST}' WHEN {_BARR.replace("cur", "p.cur")} THEN '{L.METHOD_BARRACUDA}' ELSE '{L.METHOD_SHORTENER}' END AS rm,
        loc IS NOT NULL AND (({_MIME.replace("cur", "p.cur")} OR {_BARR.replace("cur", "p.cur")}) AND (u.cur = p.cur OR u.method NOT IN (
            {o.values([L.METHOD_SAFELINKS, L.METHOD_PP_V3, L.METHOD_PP_V2, L.METHOD_GOOGLE, L.METHOD_BARRACUDA])})) OR ({_SHORT.replace("cur", "p.cur")} AND u.cur = p.cur)) AS follow
        FROM rd{_i - 1} p JOIN ({o.unwrap_pass(f"rd{_i - 1}")}) u ON p.url = u.url LEFT JOIN redirect_one r ON p.cur = r.rurl""", f"rd{_i - 1}", "redirect_one")
    o.cte(f"rd{_i}", f"""SELECT url, CASE WHEN follow THEN loc ELSE plain END AS cur, CASE WHEN follow AND loc <> before THEN rm ELSE m END AS method,
        CASE WHEN follow THEN pw OR loc <> before ELSE w END AS wrapped FROM rx{_i}""", f"rx{_i}")


@query("SELECT url, cur AS cleaned, method, wrapped AS was_wrapped FROM rd6", "rd6")
def redirect_join(spark, d):
    du = written(distinct_links(spark, d))
    return unwrap.clean_urls(du, snapshot(spark, lookups.REDIRECT_MAP, du))


@query(f"SELECT url, '[' || method || '] ' || url || chr(10) || '  → Real destination: ' || cur AS line FROM uw6 WHERE wrapped", "uw6")
def url_clean_summary(spark, d):
    return unwrap.cleaning_summary(unwrap.clean_urls(distinct_links(spark, d)))


_OFF = lambda b: "CASE " + b + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.BRAND_OFFICIAL.items()) + " END"
_CHECKS = [
    (3, "risky_tld", f"suffix IN ({o.values(L.TRIAGE_TLDS)})"), (4, "brand_in_subdomain", "bs IS NOT NULL AND NOT contains(n, ss)"),
    (3, "brand_in_domain", "bs IS NULL AND bd IS NOT NULL AND n <> sd AND NOT ends_with(n, '.' || sd)"), (3, "ip_host", o.has("url", f"^https?://{net.IPV4}")),
    (2, "shortener", o.any_in("n", L.TRIAGE_SHORTENERS)), (2, "keywords", "kw"),
    (2, "digit_domain", f"label <> '' AND {o.n_match('label', '[0-9]')}::DOUBLE / length(label) > 0.4"), (2, "high_entropy", "entropy > 5.2"),
    (3, "punycode", "contains(lower(url), 'xn--')"), (4, "credentials_in_host", "contains(n, '@')"),
    (2, "odd_port", f"coalesce(try_cast({o.ext('netloc', ':([0-9]+)$', 1)} AS INT) NOT IN (0, 80, 443), false)"),
    (1, "nested_subdomain", "length(subdomain) - length(replace(subdomain, '.', '')) >= 2"), (3, "plain_http_keywords", "starts_with(url, 'http://') AND kw"),
    (0, "deep_path", f"{o.n_match(o.path('url'), '[^/]+')} >= 4"),
]
o.cte("triage", "SELECT url, n AS domain, greatest(0, " + ", ".join(f"CASE WHEN {c} THEN {r} ELSE 0 END" for r, _, c in _CHECKS) + ") AS severity_rank, coalesce(nullif(concat_ws(',', "
      + ", ".join(f"CASE WHEN {c} THEN '{w}' END" for _, w, c in _CHECKS) + f"), ''), 'none') AS reasons FROM (SELECT *, {_OFF('bs')} AS ss, {_OFF('bd')} AS sd FROM (SELECT *, lower(netloc) AS n, "
      f"{o.first_in('subdomain', L.BRAND_OFFICIAL)} AS bs, {o.first_in('label', L.BRAND_OFFICIAL)} AS bd, {o.any_in('lower(url)', L.TRIAGE_KEYWORDS)} AS kw FROM url_dom JOIN url_ent USING (url))) "
      "WHERE NOT contains(url, 'w3.org') AND length(url) >= 10", "url_dom", "url_ent")


@query(f"SELECT url, domain, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][severity_rank + 1] AS severity, severity_rank, reasons FROM triage", "triage")
def url_triage(spark, d):
    return urls.url_triage(distinct_links(spark, d)).withColumn("reasons", F.array_join("reasons", ","))


# --- HTML ---------------------------------------------------------------------------------

_HTML = [f"html_{n}" for n in L.HTML_FEATURES]
_HTML_DOUBLES = {"html_image_to_text_ratio", "html_link_domain_diversity"}


@query(f"SELECT page_id, {r6(_HTML, _HTML_DOUBLES)} FROM ph_feat UNION ALL SELECT mail_id, {r6(_HTML, _HTML_DOUBLES)} FROM mh_feat", "ph_feat", "mh_feat")
def html_features(spark, d):
    pages = html.html_features(fx.table(spark, d, "pages"), "html", keep=("page_id",))
    mails = html.html_features(parsed(spark, d)).withColumnRenamed("mail_id", "page_id")
    return rounded(pages.unionByName(mails))


@query("SELECT m.mail_id, coalesce(mismatches, 0)::BIGINT AS mismatches FROM mail m LEFT JOIN mh_mis USING (mail_id)", "mail", "mh_mis")
def html_href_mismatch(spark, d):
    return html.html_features(parsed(spark, d)).select("mail_id", F.col("html_href_text_mismatch_count").alias("mismatches"))


@query("SELECT m.mail_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(domains, 0)::BIGINT AS n_domains, round(CASE WHEN coalesce(links, 0) = 0 THEN 0.0 ELSE domains::DOUBLE / links END, 6) AS diversity "
       "FROM mail m LEFT JOIN mh_links USING (mail_id)", "mail", "mh_links")
def html_link_diversity(spark, d):
    return html.html_features(parsed(spark, d)).select(
        "mail_id", F.col("html_total_links").alias("n_links"), F.col("html_unique_domains_in_links").alias("n_domains"), F.round("html_link_domain_diversity", 6).alias("diversity"))


@query("SELECT m.mail_id, coalesce(refresh, 0) AS meta_refresh FROM mail m LEFT JOIN mh_agg USING (mail_id)", "mail", "mh_agg")
def html_meta_refresh(spark, d):
    return html.with_tags(parsed(spark, d), "body_html").select("mail_id", html.meta_refresh(F.col("_tags")).alias("meta_refresh"))


# --- text ---------------------------------------------------------------------------------

@query("SELECT mail_id, round(txt_urgency_score_normalised, 6) AS score, txt_urgency_phrase_count AS phrases FROM txt", "txt")
def urgency_score(spark, d):
    cols = text.urgency_columns(F.col("body_text"))
    return parsed(spark, d).select("mail_id", F.round(cols["urgency_score_normalised"], 6).alias("score"), cols["urgency_phrase_count"].alias("phrases"))


_SUBJ = [f"txt_{n}" for n in L.TEXT_FEATURES[2:]]


@query(f"SELECT mail_id, {r6(_SUBJ, {'txt_subject_caps_ratio'})} FROM txt", "txt")
def subject_features(spark, d):
    return rounded(text.text_features(parsed(spark, d)).select("mail_id", *_SUBJ))


o.cte("tok", f"SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(translate(lower(text), {o.lit(X.ACCENTS[0])}, {o.lit(X.ACCENTS[1])}), "
      + o.lit(r"[\p{L}\p{N}_]{2,}") + ") AS w FROM documents)")
o.cte("term", "SELECT doc_id, t AS term FROM tok UNION ALL SELECT doc_id, t || ' ' || nxt FROM (SELECT doc_id, t, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM tok) WHERE nxt IS NOT NULL", "tok")
o.cte("vocab", "SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM term GROUP BY term "
      "HAVING count(DISTINCT doc_id) >= 2 ORDER BY tf DESC, term LIMIT 500", "term")


@query("SELECT term, tf, df, round(idf, 6) AS idf FROM vocab", "vocab")
def tfidf_vocab(spark, d):
    return rounded(text.tfidf_vocabulary(fx.table(spark, d, "documents"), "doc_id", "text"))


@query("SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM (SELECT doc_id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM term JOIN vocab USING (term) GROUP BY doc_id, term)",
       "term", "vocab")
def tfidf_weights(spark, d):
    docs = fx.table(spark, d, "documents")
    return rounded(text.tfidf_weights(docs, "doc_id", "text", text.tfidf_vocabulary(docs, "doc_id", "text")))


@query("SELECT doc_id AS mail_id, vec_id IS NOT NULL AS known, round(coalesce(embedding[1], 0)::DOUBLE, 6) AS first_value, coalesce(len(embedding), 64) AS dim FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def embedding_attach(spark, d):
    vec = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("mail_id"), "embedding")
    out = text.attach_embeddings(fx.table(spark, d, "documents").select(F.col("doc_id").alias("mail_id")), vec, dim=64)
    first = F.element_at("embedding", 1)
    return out.select("mail_id", F.exists("embedding", lambda v: v != 0).alias("known"), F.round(first.cast("double"), 6).alias("first_value"), F.size("embedding").alias("dim"))


_SEEN = o.every("text", f"[^{X.SPACE}]+")
_DIGITS = "CAST(('0x' || substr(md5(w), j::INT, 1)) AS INT)"
o.cte("all_text", "SELECT doc_id AS mail_id, 1 AS run, text FROM documents UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, 2, text FROM conversations")
o.cte("seen_text", f"SELECT mail_id, run, w, CASE WHEN len(w) > {L.EMBEDDING_WORDS} THEN array_to_string(list_slice(w, 1, {L.EMBEDDING_WORDS}), ' ') ELSE text END AS seen FROM (SELECT mail_id, run, text, coalesce({_SEEN}, []) AS w FROM all_text)", "all_text")


def all_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of documents and of conversations: ``mail_id, text``."""
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("mail_id"), "text")
    return docs.unionByName(fx.table(spark, d, "conversations").select((1000000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("mail_id"), "text"))


def refreshed(df: DataFrame, root: str) -> int:
    return stored_vectors.refresh(df, "text", root, "digits", embedding.digest_projection)


@query("SELECT run::INT AS run, n_new, sum(n_new) OVER (ORDER BY run)::BIGINT AS n_stored FROM (SELECT r.run, count(f.seen) AS n_new FROM (VALUES (1), (2), (3)) r(run) LEFT JOIN "
       "(SELECT seen, min(run) AS run FROM seen_text WHERE len(w) > 0 GROUP BY seen) f USING (run) GROUP BY r.run)", "seen_text")
def embedding_refresh(spark, d):
    """Three refreshes: documents, then with the conversations, then nothing new."""
    root = scratch(spark)
    docs, both = fx.table(spark, d, "documents"), all_texts(spark, d)
    made = [refreshed(docs, root), refreshed(both, root), refreshed(both, root)]
    sizes = [stored_vectors.stored(spark, root, "digits", upto=n).agg(F.count("*").alias("n_stored")).select(F.lit(run).alias("run"), F.lit(made[run - 1]).cast("bigint").alias("n_new"), "n_stored")
             for run, n in ((1, 1), (2, 2), (3, 3))]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@query(f"SELECT mail_id, string_agg(v, ',' ORDER BY j) AS components FROM (SELECT mail_id, j, CAST(coalesce(sum(2 * {_DIGITS} - 15) FILTER (w IS NOT NULL), 0) AS INT)::VARCHAR AS v FROM "
       f"(SELECT mail_id, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE list_slice(w, 1, {L.EMBEDDING_WORDS}) END) AS w FROM seen_text), range(1, {embedding.PROJECTION_DIM + 1}) r(j) GROUP BY mail_id, j) GROUP BY mail_id", "seen_text")
def embedding_compute(spark, d):
    """The stored vector of every text."""
    root, both = scratch(spark), all_texts(spark, d)
    refreshed(both, root)
    out = embedding.with_vectors(both, "text", stored_vectors.stored(spark, root, "digits"), embedding.PROJECTION_DIM)
    return out.select("mail_id", F.array_join(F.col("embedding").cast("array<int>"), ",").alias("components"))


_W = o.every("text", f"[^{X.SPACE}]+")


@query(f"SELECT doc_id, least(len({_W}), 128) AS n_words, md5(CASE WHEN len({_W}) > 128 THEN array_to_string(list_slice({_W}, 1, 128), ' ') ELSE text END) AS h FROM documents")
def truncate_words(spark, d):
    t = text.truncate_words(F.col("text"), 128)
    return fx.table(spark, d, "documents").select("doc_id", X.word_count(t).alias("n_words"), F.md5(t).alias("h"))


# --- reputation ---------------------------------------------------------------------------

@query("SELECT mail_id, pos::INT AS pos, m.url, coalesce(malicious, -1) AS vt_malicious, coalesce(suspicious, -1) AS vt_suspicious, coalesce(clean, -1) AS vt_clean, coalesce(reputation, 0) AS vt_reputation "
       "FROM mail_url m LEFT JOIN url_rep USING (url)", "mail_url", "url_rep")
def rep_url(spark, d):
    found = mail.link_rows(mail_table(spark, d))
    return reputation.rep_url(found, snapshot(spark, lookups.URL_REP, urls.distinct_urls(found)))


@query("SELECT mail_id, m.domain, coalesce(malicious, -1) AS vt_malicious, coalesce(suspicious, -1) AS vt_suspicious, coalesce(clean, -1) AS vt_clean, coalesce(reputation, 0) AS vt_reputation "
       "FROM mail_dom m LEFT JOIN domain_rep USING (domain)", "mail_dom", "domain_rep")
def rep_domain(spark, d):
    p = mail_table(spark, d)
    return reputation.rep_domain(urls.mail_domains(p), snapshot(spark, lookups.DOMAIN_REP, link_domains(urls.distinct_urls(mail.link_rows(p)))))


@query("SELECT m.mail_id, m.gsb_is_flagged, m.gsb_threat_count, listed FROM block_mail m JOIN (SELECT mail_id, max(coalesce(w.listed, -1)) AS listed FROM mail_url LEFT JOIN malware_urls w USING (url) GROUP BY 1) x USING (mail_id)",
       "block_mail", "mail_url", "malware_urls")
def rep_blocklist(spark, d):
    found = mail.link_rows(mail_table(spark, d))
    du = urls.distinct_urls(found)
    block = reputation.rep_blocklist(found, snapshot(spark, lookups.BLOCKLIST, du))
    listed = reputation.rep_malware_url(found, snapshot(spark, lookups.MALWARE_URLS, du)).groupBy("mail_id").agg(F.max("urlhaus_threat").alias("listed"))
    return block.join(listed, "mail_id")


@query(f"SELECT s.mail_id, s.ip, coalesce(score, -1) AS abuse_confidence_score, coalesce(reports, -1) AS abuse_total_reports, coalesce(is_tor, -1) AS abuse_is_tor "
       f"FROM sender s LEFT JOIN ip_rep r ON s.ip = r.ip AND NOT {o.has('s.ip', o.PRIVATE_REP)}", "sender", "ip_rep")
def rep_ip(spark, d):
    ips = reputation.sender_ips(mail_table(spark, d))
    return reputation.rep_ip(ips, snapshot(spark, lookups.IP_REP, ips.select("ip").distinct()))


@query("SELECT mail_id, pos::INT AS pos, m.url, coalesce(malicious, -1) AS urlscan_malicious, coalesce(brand, -1) AS urlscan_brand_impersonated, coalesce(redirects, -1) AS urlscan_redirect_count "
       "FROM mail_url m LEFT JOIN url_scan USING (url)", "mail_url", "url_scan")
def rep_scan(spark, d):
    found = mail.link_rows(mail_table(spark, d))
    return reputation.rep_scan(found, snapshot(spark, lookups.URL_SCAN, urls.distinct_urls(found)))


@query("SELECT mail_id, kind, key, fraud_score, fraud_flag FROM fraud_one", "fraud_one")
def rep_fraud(spark, d):
    keys = scoring.fraud_keys(mail_table(spark, d))
    return reputation.rep_fraud(keys, snapshot(spark, lookups.FRAUD_REP, keys.select("kind", F.col("key").alias("item")).distinct()))


@query(f"SELECT mail_id, {', '.join(features.INTEL)} FROM intel", "intel")
def intel_features(spark, d):
    p = mail_table(spark, d)
    s = snapshots(spark, p)
    return reputation.intel_features(p, mail.link_rows(p), s.url_rep, s.blocklist, s.url_scan, s.malware_urls, s.ip_rep)


def _tool_input(spark: SparkSession, d: str) -> DataFrame:
    p = mail_table(spark, d)
    s = snapshots(spark, p)
    intel = reputation.intel_features(p, mail.link_rows(p), s.url_rep, s.blocklist, s.url_scan, s.malware_urls, s.ip_rep)
    fraud = scoring.fraud_scores(p, s.fraud_rep)
    return intel.join(fraud, "mail_id", "left").fillna(-1)


_TOOLS = [f"{t}_verdict" for t in reputation.TOOLS]


@query(f"SELECT mail_id, {', '.join(_TOOLS)} FROM tools", "tools")
def tool_verdicts(spark, d):
    return reputation.tool_verdicts(_tool_input(spark, d)).select("mail_id", *_TOOLS)


@query("SELECT tool, count_if(v = 'MALICIOUS')::BIGINT AS malicious, count_if(v = 'SUSPICIOUS')::BIGINT AS suspicious, count_if(v = 'CLEAN')::BIGINT AS clean, count_if(v = 'N/A')::BIGINT AS not_checked FROM ("
       + " UNION ALL ".join(f"SELECT '{t}' AS tool, {t}_verdict AS v FROM tools" for t in reputation.TOOLS) + ") GROUP BY tool", "tools")
def tool_tally(spark, d):
    return reputation.tool_tally(reputation.tool_verdicts(_tool_input(spark, d)))


@query(f"""SELECT mail_id, m.url AS ioc, 'URL' AS type, CASE WHEN greatest(malicious, 0) > 0 OR listed = 1 THEN 'MALICIOUS' WHEN greatest(suspicious, 0) > 0 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict,
    'engines ' || greatest(coalesce(malicious, -1), 0) || '/' || (greatest(coalesce(malicious, -1), 0) + greatest(coalesce(clean, -1), 0)) AS detail, 'HIGH' AS weight
  FROM mail_url m LEFT JOIN url_rep r ON m.url = r.url LEFT JOIN malware_urls w ON m.url = w.url
  UNION ALL SELECT mail_id, s.ip, 'IP', CASE WHEN score >= 50 THEN 'MALICIOUS' WHEN score >= 20 THEN 'SUSPICIOUS' ELSE 'CLEAN' END, 'confidence ' || score || '%', 'MEDIUM' FROM sender s JOIN ip_rep r ON s.ip = r.ip AND NOT {o.has('s.ip', o.PRIVATE_REP)}
  UNION ALL SELECT mail_id, key, 'Email', CASE WHEN fraud_score >= 75 THEN 'SUSPICIOUS' ELSE 'CLEAN' END, 'fraud ' || fraud_score || '/100', 'MEDIUM' FROM fraud_one WHERE kind = 'email' AND fraud_score <> -1""",
       "mail_url", "url_rep", "malware_urls", "sender", "ip_rep", "fraud_one")
def evidence_table(spark, d):
    p = mail_table(spark, d)
    s = snapshots(spark, p)
    facts = reputation.rep_malware_url(reputation.rep_url(mail.link_rows(p), s.url_rep), s.malware_urls)
    ips = reputation.rep_ip(reputation.sender_ips(p), s.ip_rep)
    addresses = reputation.rep_fraud(scoring.fraud_keys(p).where("kind = 'email'"), s.fraud_rep)
    return reputation.evidence_table(facts, ips, addresses)


@query(f"SELECT DISTINCT ip, {o.has('ip', o.PRIVATE)} AS private_indicator, {o.has('ip', o.PRIVATE_REP)} AS private_reputation FROM relay_ip", "relay_ip")
def private_ip(spark, d):
    m = mail.mail_fields(fx.mail_raw(spark, d))
    ips = rows.explode_values(m, [], F.flatten(F.transform("received", net.ips_in)), "ip").distinct()
    return ips.select("ip", net.is_private_ip(F.col("ip")).alias("private_indicator"), net.is_private_ip(F.col("ip"), L.PRIVATE_PREFIXES_REPUTATION).alias("private_reputation"))


# --- failed rows --------------------------------------------------------------------------

o.cte("faulty", fx.MAIL_FAULTY.format(mails="SELECT * FROM mail_raw"), "mail_raw")
_DATE = o.ext("raw_email", "(?:^|\\n)Date: [A-Za-z]+, ([^\\n]*)", 1)
_FAULTS = ("SELECT mail_id, 'input' AS stage, 'no text' AS reason FROM faulty WHERE raw_email IS NULL OR trim(raw_email, ' ' || chr(10)) = '' "
           f"UNION ALL SELECT mail_id, 'header', 'unreadable date: Mon, ' || {_DATE} FROM faulty WHERE {_DATE} <> '' AND try_strptime({_DATE}, '%d %b %Y %H:%M:%S %z') IS NULL "
           "UNION ALL SELECT mail_id, 'mime', 'part 0 can''t be decoded: text/plain' FROM faulty WHERE contains(raw_email, 'charset=x-nothing') "
           f"UNION ALL SELECT mail_id, 'link', 'no host: ' || {o.ext('raw_email', 'http:///[^ ]*')} FROM faulty WHERE contains(raw_email, 'http:///') "
           "UNION ALL SELECT mail_id, 'label', 'unknown label: ' || label FROM faulty WHERE label NOT IN ('0', '1')")
o.cte("fault", _FAULTS, "faulty")


def flagged(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """Parsed mails with their faults, written once, and the counts observed on the way."""
    df, seen = quarantine.counted(quarantine.with_faults(fx.mail_faulty(spark, d), "label"))
    return written(df), seen.get


@query("SELECT * FROM fault", "fault")
def failed_rows(spark, d):
    return quarantine.failed_rows(flagged(spark, d)[0])


@query("SELECT mail_id, md5(subject || '|' || body_text || '|' || body_html) AS h FROM mail WHERE mail_id NOT IN (SELECT mail_id FROM fault)", "mail", "fault")
def good_rows(spark, d):
    """Mails without a fault are as if there were no others."""
    good = quarantine.good_rows(flagged(spark, d)[0])
    return good.select("mail_id", F.md5(F.concat_ws("|", "subject", "body_text", "body_html")).alias("h"))


@query("SELECT stage, n FROM (SELECT 'rows' AS stage, count(*) AS n FROM faulty UNION ALL SELECT 'failed', count(DISTINCT mail_id) FROM fault UNION ALL "
       "SELECT s.stage, count(DISTINCT mail_id) FROM (VALUES ('input'), ('header'), ('mime'), ('link'), ('label')) s(stage) LEFT JOIN fault USING (stage) GROUP BY s.stage)", "faulty", "fault")
def failed_counts(spark, d):
    counts = flagged(spark, d)[1]
    return spark.createDataFrame([(k.removeprefix("n_"), v) for k, v in counts.items()], "stage string, n long")


# --- features -----------------------------------------------------------------------------

_ALL = [*features.SCALARS, *features.INTEL]
_ALL_DOUBLES = {c for c in _ALL if c.endswith(("_mean", "_max", "_ratio", "_diversity", "_normalised", "_risk"))}


@query(f"SELECT mail_id, {r6(_ALL, _ALL_DOUBLES)} FROM feat", "feat")
def feature_table(spark, d):
    return rounded(full_features(spark, d))


@query("SELECT grp, count(*) AS n_values, count_if(value <> 0)::BIGINT AS n_nonzero FROM (SELECT CASE split_part(name, '_', 1) WHEN 'hdr' THEN 'Header' WHEN 'url' THEN 'URL' WHEN 'html' THEN 'HTML' WHEN 'txt' THEN 'Text' ELSE 'Intel' END AS grp, value "
       f"FROM (UNPIVOT (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in _ALL)} FROM feat) ON {', '.join(_ALL)} INTO NAME name VALUE value)) GROUP BY grp", "feat")
def feature_profile(spark, d):
    return features.feature_profile(full_features(spark, d), _ALL)


_MAIL_BODY = "CASE WHEN body_text <> '' THEN body_text ELSE body_html END"
o.cte("mtok", f"SELECT mail_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT mail_id, regexp_extract_all(translate(lower({_MAIL_BODY}), {o.lit(X.ACCENTS[0])}, {o.lit(X.ACCENTS[1])}), "
      + o.lit(r"[\p{L}\p{N}_]{2,}") + ") AS w FROM mail)", "mail")
o.cte("mterm", "SELECT mail_id, t AS term FROM mtok UNION ALL SELECT mail_id, t || ' ' || nxt FROM (SELECT mail_id, t, lead(t) OVER (PARTITION BY mail_id ORDER BY i) AS nxt FROM mtok) WHERE nxt IS NOT NULL", "mtok")
o.cte("mvocab", "SELECT *, row_number() OVER (ORDER BY term) - 1 AS pos FROM (SELECT term, count(*) AS tf, count(DISTINCT mail_id) AS df, "
      "ln(((SELECT count(*) FROM mail) + 1)::DOUBLE / (count(DISTINCT mail_id) + 1)) + 1 AS idf FROM mterm GROUP BY term HAVING count(DISTINCT mail_id) >= 2 ORDER BY tf DESC, term LIMIT 500)", "mterm", "mail")
o.cte("mweight", "SELECT mail_id, pos, w / sqrt(sum(w * w) OVER (PARTITION BY mail_id)) AS value FROM (SELECT mail_id, pos, (1 + ln(count(*))) * any_value(idf) AS w FROM mterm JOIN mvocab USING (term) GROUP BY mail_id, pos)",
      "mterm", "mvocab")
_DIM = 64


def published_vocabulary(spark: SparkSession, mails: DataFrame) -> tuple[DataFrame, dict]:
    """The vocabulary of the mails' texts as it is read back from its published version."""
    root = scratch(spark)
    texts = mails.select("mail_id", features.text_for_model().alias("text"))
    registry.publish_vocabulary(sparse.ordered_vocabulary(texts, "mail_id", "text"), _ALL, _DIM, root, "mail_terms")
    return registry.load(spark, root, "mail_terms")


def mail_weights(mails: DataFrame, vocabulary: DataFrame) -> DataFrame:
    texts = mails.select("mail_id", features.text_for_model().alias("text"))
    return sparse.tfidf_rows(texts, "mail_id", "text", vocabulary).withColumnRenamed("doc_id", "mail_id")


@query("SELECT term, pos::INT AS pos, tf, df, round(idf, 6) AS idf, 1 AS version FROM mvocab", "mvocab")
def vocabulary_saved(spark, d):
    vocabulary, record = published_vocabulary(spark, mail_table(spark, d))
    return rounded(vocabulary.select("term", "pos", "tf", "df", "idf", F.lit(record["version"]).alias("version")))


@query("SELECT m.mail_id, count(t.term)::INT AS n_terms, count_if(t.term IS NOT NULL AND v.term IS NULL)::INT AS n_unseen, count(DISTINCT v.term)::INT AS n_known FROM mail m LEFT JOIN mterm t USING (mail_id) "
       "LEFT JOIN mvocab v USING (term) GROUP BY m.mail_id", "mail", "mterm", "mvocab")
def vocabulary_use(spark, d):
    p = mail_table(spark, d)
    return mail_weights(p, published_vocabulary(spark, p)[0]).select("mail_id", "n_terms", "n_unseen", F.size("tfidf.indices").alias("n_known"))


@query(f"SELECT mail_id, index::INT AS index, round(value, 6) AS value, (SELECT count(*) FROM mvocab)::INT + {len(_ALL) + _DIM} AS width FROM ("
       f"SELECT mail_id, list_position([{', '.join(map(o.lit, _ALL))}], name) - 1 AS index, value FROM (UNPIVOT (SELECT mail_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in _ALL)} FROM feat) ON {', '.join(_ALL)} INTO NAME name VALUE value) "
       f"UNION ALL SELECT vec_id, {len(_ALL)} + i, embedding[i + 1]::DOUBLE FROM embeddings JOIN feat ON vec_id = mail_id, range({_DIM}) r(i) "
       f"UNION ALL SELECT mail_id, {len(_ALL) + _DIM} + pos, value FROM mweight) WHERE value <> 0", "feat", "mvocab", "mweight")
def feature_vector(spark, d):
    """Entries of the sparse vector of every mail: scalars, dense part and the terms of a published vocabulary."""
    p = mail_table(spark, d)
    vocabulary, record = published_vocabulary(spark, p)
    size = vocabulary.count()
    vec = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("mail_id"), "embedding")
    table = text.attach_embeddings(scoring.feature_table(p, snapshots(spark, p)), vec, dim=_DIM).join(mail_weights(p, vocabulary), "mail_id")
    parts = features.feature_vector(table, record["features"], "tfidf", size, "embedding", record["embedding_dim"]).select("mail_id", "features")
    vectors = sparse.as_vectors(parts, scratch(spark))
    return sparse.vector_entries(vectors.withColumn("width", F.unwrap_udt("features")["size"]), ["mail_id", "width"]).select("mail_id", "index", F.round("value", 6).alias("value"), "width")


# --- learning -----------------------------------------------------------------------------

def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Labelled vectors: one class against the rest."""
    e = fx.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("mail_id"), (F.col("label") % 2).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))


def training(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("mail_id", "label", array_to_vector("vec").alias("features"))


_OL = ["l_quantity", "l_extendedprice", "l_discount"]


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round((x.{c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 5) AS {c}" for c in _OL) + " FROM (SELECT l_orderkey, l_linenumber, "
       + ", ".join(f"{c}::DOUBLE AS {c}" for c in _OL) + " FROM lineitem) x, (SELECT " + ", ".join(f"avg({c}::DOUBLE) AS m_{c}, stddev_pop({c}::DOUBLE) AS s_{c}" for c in _OL) + " FROM lineitem) s")
def standardise(spark, d):
    df = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in _OL])
    return rounded(learn.standardise(df, _OL), 5)


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round((x.{c} - a_{c}) / CASE WHEN b_{c} = a_{c} THEN 1 ELSE b_{c} - a_{c} END, 6) AS {c}" for c in _OL) + " FROM (SELECT l_orderkey, l_linenumber, "
       + ", ".join(f"{c}::DOUBLE AS {c}" for c in _OL) + " FROM lineitem) x, (SELECT " + ", ".join(f"min({c}::DOUBLE) AS a_{c}, max({c}::DOUBLE) AS b_{c}" for c in _OL) + " FROM lineitem) s")
def minmax(spark, d):
    df = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in _OL])
    return rounded(minmax_scale(df, _OL))


@query("SELECT label::INT AS label, n, round((SELECT count(*) FROM curated)::DOUBLE / ((SELECT count(DISTINCT label) FROM curated) * n), 6) AS weight FROM (SELECT label, count(*) AS n FROM curated GROUP BY label)", "curated")
def class_weights(spark, d):
    return corpus.class_weights(curated(spark, d))


@query("SELECT mail_id, label::INT AS label, ((rn - 1) * 5 // n)::INT AS fold FROM (SELECT mail_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || mail_id)) AS rn, count(*) OVER (PARTITION BY label) AS n FROM curated)", "curated")
def kfold_assign(spark, d):
    return corpus.assign_folds(curated(spark, d), 5).select("mail_id", "label", "fold")


def _fit_and_score(spark: SparkSession, d: str, name: str, params: dict) -> DataFrame:
    data = corpus.stratified_split(training(spark, d))
    train = data.where("split = 'train'")
    model = learn.fitted(name, learn.with_class_weight(train), params, rows=train.count())
    return learn.score(model, data.where("split = 'test'")).withColumn("prob", F.round("prob", 4))


@query()
def lr_scores(spark, d):
    return _fit_and_score(spark, d, "lr", {})


@query()
def rf_scores(spark, d):
    return _fit_and_score(spark, d, "rf", {})


@query()
def gbt_scores(spark, d):
    return _fit_and_score(spark, d, "gbt_depth", {})


@query()
def gbt_leaf_scores(spark, d):
    return _fit_and_score(spark, d, "gbt_leaf", {})


@query()
def gbt_plain_scores(spark, d):
    return _fit_and_score(spark, d, "gbt_plain", {})


@query()
def smote_rows(spark, d):
    e = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("mail_id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    few, rest = e.where("label = 1"), e.where("label <> 1")
    made = learn.synthetic_rows(few, rest.count() - few.count())
    return made.select("base", "neighbour", F.round("u", 6).alias("u"), F.size("vec").alias("dim"))


@query("SELECT id, rank::INT AS rank, neighbour FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank "
       "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5")
def knn5(spark, d):
    pts = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return learn.nearest(pts, pts, 5)


@query()
def param_grid(spark, d):
    best, scored = learn.tune("lr", training(spark, d), trials=50, k=3)
    return spark.createDataFrame([(i, float(p["C"]), int(p["max_iter"]), float(f), p == best) for i, (p, f) in enumerate(scored)], "trial int, c double, max_iter int, f1 double, best boolean")


@query()
def cross_validation(spark, d):
    cv = learn.cross_validate("lr", training(spark, d), k=3)
    return spark.createDataFrame([("lr", cv["cv_f1_mean"], cv["cv_f1_std"])], "model string, f1_mean double, f1_std double")


@query()
def anomaly_scores(spark, d):
    data = vectors(spark, d)
    return rounded(OutlierForest.fit(data).scores(data))


@query()
def anomaly_drivers(spark, d):
    data = vectors(spark, d)
    forest = OutlierForest.fit(data)
    return rounded(forest.drivers(data, [f"v{i}" for i in range(64)], top=5))


# --- evaluation ---------------------------------------------------------------------------

_CONF = """SELECT {g}, tp, tn, fp, fn, n_test, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn)::DOUBLE / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc,
  round(CASE WHEN fn + tp = 0 THEN 0 ELSE fn::DOUBLE / (fn + tp) END, 6) AS fnr, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp::DOUBLE / (fp + tn) END, 6) AS fpr
  FROM (SELECT {g}, count_if(label = 1 AND prob >= {t})::BIGINT AS tp, count_if(label = 0 AND prob < {t})::BIGINT AS tn, count_if(label = 0 AND prob >= {t})::BIGINT AS fp, count_if(label = 1 AND prob < {t})::BIGINT AS fn, count(*) AS n_test FROM {s} GROUP BY {g})"""


@query(_CONF.format(g="model", t=0.5, s="scored"), "scored")
def confusion_metrics(spark, d):
    return evaluate.confusion_metrics(scored_mails(spark, d))


_AUC = ("SELECT model, n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg), 6) AS auc_roc FROM (SELECT model, count_if(label = 1)::BIGINT AS n_pos, count_if(label = 0)::BIGINT AS n_neg, "
       "sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS rs FROM (SELECT model, label, rank() OVER w + (count(*) OVER (PARTITION BY model, prob) - 1) / 2.0::DOUBLE AS r FROM scored WINDOW w AS (PARTITION BY model ORDER BY prob)) GROUP BY model)")


@query(_AUC, "scored")
def auc_rank(spark, d):
    return evaluate.auc(scored_mails(spark, d))


_RECORD = f"SELECT *, 0.5::DOUBLE AS threshold FROM ({_CONF.format(g='model', t=0.5, s='scored')}) JOIN (SELECT model, auc_roc FROM ({_AUC})) USING (model)"


@query(_RECORD, "scored")
def metrics_record(spark, d):
    """All fields of the evaluation of each model."""
    return evaluate.evaluate(scored_mails(spark, d))


@query(_RECORD, "scored")
def metrics_file(spark, d):
    """The evaluation records written as JSON lines and read back."""
    out, record = scratch(spark), evaluate.evaluate(scored_mails(spark, d))
    exports.write_json(record, out)
    return spark.read.schema(record.schema).json(out)


@query(f"SELECT model, f1, row_number() OVER (ORDER BY f1 DESC, model)::INT AS place FROM ({_CONF.format(g='model', t=0.5, s='scored')})", "scored")
def model_compare(spark, d):
    return evaluate.compare_models(evaluate.confusion_metrics(scored_mails(spark, d)))


@query("SELECT coalesce(source, 'ALL') AS source, coalesce(model, 'ALL') AS model, count_if(label = 1 AND prob >= 0.5)::BIGINT AS tp, count_if(label = 0 AND prob >= 0.5)::BIGINT AS fp, count_if(label = 1 AND prob < 0.5)::BIGINT AS fn, count(*) AS n_test, "
       "round(CASE WHEN count_if(label = 1 OR prob >= 0.5) = 0 THEN 0 ELSE 2.0::DOUBLE * count_if(label = 1 AND prob >= 0.5) / (2 * count_if(label = 1 AND prob >= 0.5) + count_if(label = 0 AND prob >= 0.5) + count_if(label = 1 AND prob < 0.5)) END, 6) AS f1 FROM scored GROUP BY CUBE (source, model)", "scored")
def metrics_by_source(spark, d):
    return evaluate.metrics_by_source(scored_mails(spark, d))


_SCORED_ON = ["url_tld_risk_score_max", "hdr_from_reply_to_mismatch", "hdr_spf_result", "txt_urgency_phrase_count"]


o.cte("noisy", "SELECT mail_id, noise_sigma, " + ", ".join(f"{o.noise(c, 'noise_sigma')} AS {c}" for c in _SCORED_ON) + " FROM hdr JOIN url_feat USING (mail_id) JOIN txt USING (mail_id), "
      "(SELECT unnest([0.0, 0.05, 0.1, 0.2]::DOUBLE[]) AS noise_sigma)", "hdr", "url_feat", "txt")
o.cte("noisy_scored", f"SELECT noise_sigma, label, {o.PROB} AS prob FROM noisy JOIN (SELECT mail_id, label FROM mail) USING (mail_id)", "noisy", "mail")


@query("SELECT noise_sigma, f1, n_test FROM (" + _CONF.format(g="noise_sigma", t=0.5, s="noisy_scored") + ")", "noisy_scored")
def noise_stress(spark, d):
    table = features.scalar_features(parsed(spark, d), keep=("mail_id", "label"))
    noisy = evaluate.with_noise(table, [c for c in table.columns if c not in ("mail_id", "label")])
    return evaluate.confusion_metrics(noisy.withColumn("prob", fixed_probability()), ["noise_sigma"]).select("noise_sigma", "f1", "n_test")


_FAIL = [*features.SCALARS, *features.INTEL]
o.cte("wrong", f"SELECT feat.*, CASE WHEN label = 1 THEN 'false_negative' ELSE 'false_positive' END AS mode FROM feat JOIN pscore USING (mail_id) JOIN (SELECT mail_id, label FROM mail) USING (mail_id) WHERE (label = 1) <> (prob >= 0.5)", "feat", "pscore", "mail")


@query("SELECT mode, feature, mean_value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY mean_value DESC, feature) AS rank FROM (SELECT mode, feature, round(avg(value), 6) AS mean_value "
       f"FROM (UNPIVOT (SELECT mode, {', '.join(f'{c}::DOUBLE AS {c}' for c in _FAIL)} FROM wrong) ON {', '.join(_FAIL)} INTO NAME feature VALUE value) GROUP BY mode, feature)) WHERE rank <= 20", "wrong")
def failure_modes(spark, d):
    p = mail_table(spark, d)
    table = written(scoring.feature_table(p, snapshots(spark, p), keep=("mail_id", "label")).withColumn("prob", fixed_probability()))
    return evaluate.failure_modes(table, _FAIL)


def _attacked(spark: SparkSession, d: str) -> DataFrame:
    raw = written(variants.all_variants(written(fx.mail_raw(spark, d).where("label = 1"))))          # six branches read the mails
    table = features.scalar_features(mail.parse_mail(raw), keep=("mail_id", "label", "attack"), names=FIXED_FEATURES)     # all that the score reads
    return table.withColumn("prob", fixed_probability())


@query()
def robustness(spark, d):
    return evaluate.robustness(_attacked(spark, d))


o.cte("f1s", "SELECT model, tp, fp, fn, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1 FROM (" + _CONF.format(g="model", t=0.5, s="scored") + ")", "scored")


@query(f"SELECT attack, f1_clean, f1_adversarial, robustness, evasion_rate, round(avg(r) OVER (), 6) AS overall_robustness, avg(r) OVER () >= 0.9 AS passed FROM (SELECT a.model AS attack, round(c.f1, 6) AS f1_clean, round(a.f1, 6) AS f1_adversarial, "
       "a.f1 / c.f1 AS r, round(a.f1 / c.f1, 6) AS robustness, round(1 - (a.tp + a.fp)::DOUBLE / (a.tp + a.fn), 6) AS evasion_rate "
       "FROM f1s a, f1s c WHERE c.model = 'gbt' AND a.model <> 'gbt')", "f1s")
def robustness_ratios(spark, d):
    s = scored_mails(spark, d).withColumn("attack", F.when(F.col("model") == "gbt", F.lit("clean")).otherwise(F.col("model")))
    return evaluate.robustness(s)


def _variant_sql(edit: str) -> str:
    return f"SELECT mail_id, md5({edit}) AS h, length({edit}) AS n_chars FROM mail_raw"


def _variant(spark: SparkSession, d: str, attack: str) -> DataFrame:
    out = variants.apply(fx.mail_raw(spark, d), attack)
    return out.select("mail_id", F.md5("raw_email").alias("h"), F.length("raw_email").alias("n_chars"))


@query(_variant_sql("CASE (mail_id + 42) % 3 " + " ".join(f"WHEN {i} THEN {o.sub('raw_email', '(https?://[^ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'f<>' + chr(34) + chr(39) + ']+)', r + chr(92) + '1')}" for i, r in enumerate(L.REDIRECTORS)) + " END"), "mail_raw")
def variant_redirect(spark, d):
    return _variant(spark, d, "url_obfuscation")


def _edit_chain(items: list[tuple[str, str]], fold: bool) -> str:
    """Nested subqueries, each editing the first occurrence of one text."""
    src = "SELECT mail_id, raw_email AS t FROM mail_raw"
    for find, new in items:
        at = f"instr({'lower(t)' if fold else 't'}, {o.lit(find)})"
        src = f"SELECT mail_id, CASE WHEN {at} > 0 THEN left(t, {at}::INT - 1) || {new} || substr(t, {at} + {len(find)}) ELSE t END AS t FROM ({src})"
    return f"SELECT mail_id, md5(t) AS h, length(t) AS n_chars FROM ({src})"


_FILL = "[" + ", ".join(o.lit(s) for s in L.URGENCY_FILLERS) + "][((mail_id + 42) % 3 + 1)::INT]"


@query(_edit_chain([(w, f"{o.lit(w)} || {_FILL}") for w in L.URGENCY_WORDS], True), "mail_raw")
def variant_filler(spark, d):
    return _variant(spark, d, "urgency_dilution")


@query(_edit_chain([(b, o.lit(b[:len(b) // 2] + L.ZERO_WIDTH[0] + b[len(b) // 2:])) for b in L.VARIANT_BRANDS], False), "mail_raw")
def variant_brand(spark, d):
    return _variant(spark, d, "brand_mutation")


def _chars(text: str) -> str:
    """The characters of a text, in order, with positions from 0."""
    return f"SELECT mail_id, head, unnest(string_split({text}, '')) AS c, generate_subscripts(string_split({text}, ''), 1) - 1 AS i"


_SIGNS = "[" + ", ".join(o.lit(c) for c in L.ZERO_WIDTH) + "]"
_BLANK_LINE = "instr(raw_email, chr(10) || chr(10))"


@query("SELECT mail_id, md5(head || t) AS h, length(head || t) AS n_chars FROM (SELECT mail_id, any_value(head) AS head, string_agg(CASE WHEN regexp_matches(c, '^\\p{L}$') AND "
       f"{o.pick(10, '1', 'mail_id', 'i')} = 0 THEN c || {_SIGNS}[({o.pick(len(L.ZERO_WIDTH), '2', 'mail_id', 'i')} + 1)::INT] ELSE c END, '' ORDER BY i) AS t FROM ("
       + _chars(f"substr(raw_email, {_BLANK_LINE} + 2)").replace("head,", f"substr(raw_email, 1, {_BLANK_LINE} + 1) AS head,") + " FROM mail_raw) GROUP BY mail_id)", "mail_raw")
def variant_zero_width(spark, d):
    return _variant(spark, d, "whitespace_insertion")


@query(f"SELECT mail_id, md5(t) AS h, length(t) AS n_chars FROM (SELECT mail_id, string_agg(CASE WHEN {o.pick(5, '3', 'mail_id', 'i')} = 0 "
       f"THEN translate(c, {o.lit(''.join(L.LOOKALIKES))}, {o.lit(''.join(L.LOOKALIKES.values()))}) ELSE c END, '' ORDER BY i) AS t FROM ("
       + _chars("raw_email").replace("head, ", "") + " FROM mail_raw) GROUP BY mail_id)", "mail_raw")
def variant_lookalikes(spark, d):
    return _variant(spark, d, "homoglyph_substitution")


# --- attribution --------------------------------------------------------------------------

_COEF = [n for n, _, _ in lookups.COEF]
o.cte("coef", f"SELECT * FROM (VALUES {lookups.COEF_ROWS}) AS c(feature, coef, mean)")
o.cte("contrib", "SELECT mail_id, feature, value, coef * (value - mean) AS contribution FROM (UNPIVOT (SELECT mail_id, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in _COEF)
      + f" FROM feat) ON {', '.join(_COEF)} INTO NAME feature VALUE value) JOIN coef USING (feature)", "feat", "coef")
_TOP = "SELECT mail_id, feature, value, contribution, row_number() OVER (PARTITION BY mail_id ORDER BY round(abs(contribution), 6) DESC, feature) AS rank FROM contrib"


def _contributions(spark: SparkSession, d: str) -> DataFrame:
    coef = spark.sql(f"SELECT * FROM VALUES {lookups.COEF_ROWS} AS c(feature, coef, mean)")
    return attribute.contributions(features.scalar_features(parsed(spark, d)), coef, _COEF)


@query(f"SELECT mail_id, rank::INT AS rank, feature, round(value, 6) AS value, round(contribution, 6) AS contribution, contribution > 0 AS raises_risk FROM ({_TOP}) WHERE rank <= 6", "contrib")
def linear_attribution(spark, d):
    return attribute.top_contributions(_contributions(spark, d), 6)


o.cte("tree_node", "SELECT * FROM (VALUES " + ", ".join(f"({t}, {n}, {'NULL' if f is None else o.lit(f)}, {'NULL' if c is None else c}::DOUBLE, {a}, {b}, {v}::DOUBLE)" for t, n, f, c, a, b, v in lookups.TREES)
      + ") AS t(tree, node, feature, threshold, l, r, value)")
o.cte("tree_case", "SELECT mail_id, replaced, feature, CASE WHEN feature = replaced THEN mean ELSE value END AS value FROM contrib JOIN coef USING (feature), (SELECT '' AS replaced UNION ALL SELECT feature FROM coef)", "contrib", "coef")
o.cte("tree_prob", """SELECT mail_id, replaced, 1 / (1 + exp(-2 * sum(leaf.value))) AS prob FROM tree_node root JOIN tree_case a ON a.feature = root.feature
  JOIN tree_node inner_ ON inner_.tree = root.tree AND inner_.node = CASE WHEN a.value <= root.threshold THEN root.l ELSE root.r END JOIN tree_case b USING (mail_id, replaced)
  JOIN tree_node leaf ON leaf.tree = root.tree AND leaf.node = CASE WHEN b.value <= inner_.threshold THEN inner_.l ELSE inner_.r END WHERE root.node = 0 AND b.feature = inner_.feature GROUP BY mail_id, replaced""", "tree_node", "tree_case")
o.cte("tree_contrib", "SELECT mail_id, feature, value, round(w.prob - x.prob, 12) AS contribution FROM contrib JOIN tree_prob x USING (mail_id) JOIN tree_prob w USING (mail_id) WHERE x.replaced = feature AND w.replaced = ''", "contrib", "tree_prob")


@query(f"SELECT mail_id, rank::INT AS rank, feature, round(value, 6) AS value, round(contribution, 6) AS contribution, contribution > 0 AS raises_risk FROM ({_TOP.replace('FROM contrib', 'FROM tree_contrib')}) WHERE rank <= 5", "tree_contrib")
def tree_attribution(spark, d):
    """The features whose means in their place change a tree ensemble's probability most."""
    place = {n: i for i, n in enumerate(_COEF)}
    nodes = spark.createDataFrame([(t, n, place.get(f, -1), c, a, b, v) for t, n, f, c, a, b, v in lookups.TREES], trees.NODES)
    made = trees.contributions(features.scalar_features(parsed(spark, d)), nodes, trees.LOGISTIC, _COEF, [m for _, _, m in lookups.COEF])
    return attribute.top_contributions(made, 5)


@query("SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM contrib GROUP BY feature", "contrib")
def population_importance(spark, d):
    return attribute.population_importance(_contributions(spark, d))


@query(f"SELECT mail_id, round(count_if(a AND b)::DOUBLE / count(*), 6) AS agreement FROM (SELECT mail_id, feature, bool_or(k = 1) AS a, bool_or(k = 2) AS b FROM (SELECT mail_id, feature, 1 AS k FROM ({_TOP}) WHERE rank <= 5 UNION ALL "
       "SELECT mail_id, feature, 2 FROM (SELECT mail_id, feature, row_number() OVER (PARTITION BY mail_id ORDER BY round(abs(value), 6) DESC, feature) AS r FROM contrib) WHERE r <= 5) GROUP BY 1, 2) GROUP BY mail_id", "contrib")
def rank_agreement(spark, d):
    return attribute.rank_agreement(_contributions(spark, d), "contribution", "value", 5)


# --- indicators ---------------------------------------------------------------------------

@query("SELECT mail_id, value FROM ioc_addr", "ioc_addr")
def ioc_addresses(spark, d):
    return rows.explode_values(mail.mail_fields(fx.mail_raw(spark, d)), ["mail_id"], indicators.addresses(), "value")


@query("SELECT mail_id, value FROM ioc_ip", "ioc_ip")
def ioc_ips(spark, d):
    return rows.explode_values(mail.mail_fields(fx.mail_raw(spark, d)), ["mail_id"], indicators.ips(), "value")


@query("SELECT mail_id, url AS value FROM ioc_url", "ioc_url")
def ioc_urls(spark, d):
    return rows.explode_values(parsed(spark, d), ["mail_id"], indicators.links(), "value")


@query("SELECT mail_id, value FROM ioc_dom", "ioc_dom")
def ioc_domains(spark, d):
    return rows.explode_values(indicators.indicator_arrays(parsed(spark, d)), ["mail_id"], "domains", "value")


@query("SELECT * FROM ioc_all", "ioc_all")
def ioc_table(spark, d):
    return indicators.indicator_rows(indicators.indicator_arrays(parsed(spark, d)))


_HASHES = {"md5": r"\b[a-fA-F0-9]{32}\b", "sha1": r"\b[a-fA-F0-9]{40}\b", "sha256": r"\b[a-fA-F0-9]{64}\b",
           "file": r"(?i)\b\S+\.(?:exe|vbs|bat|cmd|ps1|lnk|iso|img|msi|scr|jar|wsf|hta|vbe|jse)\b"}


@query(" UNION ALL ".join(f"SELECT mail_id, '{k}' AS kind, unnest({o.every('body', p)}) AS value FROM mail" for k, p in _HASHES.items()), "mail")
def ioc_hashes(spark, d):
    found = indicators.hashes_and_files(mail.body_choice())
    tagged = lambda kind, e: F.transform(e, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    pairs = F.concat(*[tagged(k, e) for k, e in found.items()])
    return rows.explode_structs(parsed(spark, d), ["mail_id"], pairs, "kind")


@query("SELECT ioc_type, value, count(*) AS n_mails, min(prob) AS min_score, max(prob) AS max_score FROM ioc_all JOIN (SELECT mail_id, prob FROM scored WHERE model = 'gbt') USING (mail_id) GROUP BY ioc_type, value", "ioc_all", "scored")
def ioc_prevalence(spark, d):
    iocs = indicators.indicator_rows(indicators.indicator_arrays(parsed(spark, d)))
    return indicators.prevalence(iocs, scored_mails(spark, d).where("model = 'gbt'").select("mail_id", F.col("prob").alias("score")))


# --- techniques ---------------------------------------------------------------------------

@query("SELECT DISTINCT mail_id, 'T1566.002' AS technique_id, 'Phishing: Spearphishing Link' AS technique_name, 'Initial Access' AS tactic, 'url' AS indicator FROM ioc_url UNION ALL "
       "SELECT DISTINCT mail_id, 'T1583.001', 'Acquire Infrastructure: Domains', 'Resource Development', 'domain' FROM ioc_dom UNION ALL "
       "SELECT mail_id, 'T1566.001', 'Phishing: Spearphishing Attachment', 'Initial Access', 'attachment' FROM attached UNION ALL "
       "SELECT mail_id, 'T1036.007', 'Masquerading: Double File Extension', 'Defense Evasion', 'attachment' FROM attached", "ioc_url", "ioc_dom", "attached")
def attack_simple(spark, d):
    return techniques.by_presence(indicators.indicator_arrays(parsed(spark, d)))


def _technique_input(spark: SparkSession, d: str) -> DataFrame:
    p = mail_table(spark, d)
    df = scoring.technique_facts(p, snapshots(spark, p)).withColumn("prob", fixed_probability())
    return df.withColumn("ai_brand", F.lit(None).cast("string")).withColumn("verdict", verdict.ml_verdict(F.col("prob")))


_TID = "mail_id, technique_id, round(round(confidence::DOUBLE, 6), 4) AS confidence"


def _tid(df: DataFrame) -> DataFrame:
    return df.select("mail_id", "technique_id", F.round("confidence", 4).alias("confidence"))


@query(f"SELECT {_TID} FROM rule_row", "rule_row")
def attack_rules(spark, d):
    return _tid(rows.explode_structs(_technique_input(spark, d), ["mail_id"], techniques.rule_array(), "technique_id"))


@query("SELECT mail_id, technique_id, 0.65::DOUBLE AS confidence FROM config_row", "config_row")
def attack_config(spark, d):
    df = _technique_input(spark, d).withColumn("_rules", techniques.rule_array())
    return _tid(rows.explode_structs(df, ["mail_id"], techniques.map_array(F.col("_rules")), "technique_id"))


@query(f"SELECT {_TID} FROM technique_kept", "technique_kept")
def attack_calibrated(spark, d):
    return _tid(techniques.technique_rows(techniques.calibrate(techniques.with_techniques(_technique_input(spark, d)))))


_TACTIC = "CASE technique_id " + " ".join(f"WHEN '{t}' THEN '{v[1]}'" for t, v in {**L.TECHNIQUES, **{x[0]: (x[1], x[2]) for x in L.FEATURE_TECHNIQUES.values() if x[0] not in L.TECHNIQUES}}.items()) + " END"


@query(f"SELECT tactic, technique_id, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM (SELECT *, {_TACTIC} AS tactic FROM technique_kept) GROUP BY tactic, technique_id UNION ALL "
       f"SELECT {_TACTIC} AS tactic, 'ALL', count(*), round(avg(confidence), 4) FROM technique_kept GROUP BY 1", "technique_kept")
def attack_prevalence(spark, d):
    found = techniques.technique_rows(techniques.calibrate(techniques.with_techniques(_technique_input(spark, d))))
    return techniques.prevalence(found).withColumn("mean_confidence", F.round("mean_confidence", 4))


# --- findings -----------------------------------------------------------------------------

def _rows_sql(items: list[tuple[str, str, str, str]], src: str) -> str:
    return " UNION ALL ".join(f"SELECT mail_id, '{s}' AS severity, {t} AS title, {x} AS detail FROM {src} WHERE {c}" for c, s, t, x in items)


_DOM = "lower(" + o.ext("from_address", "@([a-zA-Z0-9_.-]+)", 1) + ")"
o.cte("hf_in", "SELECT * FROM mail JOIN hdr USING (mail_id)", "mail", "hdr")
o.cte("hf", _rows_sql([
    ("hdr_spf_result < 0", "HIGH", "'SPF Authentication FAILED'", _DOM), ("hdr_spf_result = 0", "MEDIUM", "'SPF Neutral / No SPF Policy'", _DOM), ("hdr_spf_result > 0", "INFO", "'SPF Authentication Passed'", _DOM),
    ("hdr_dkim_result < 0", "HIGH", "'DKIM Signature Invalid / Missing'", _DOM), ("hdr_dkim_result = 0", "MEDIUM", "'DKIM Signature Not Verified'", _DOM), ("hdr_dkim_result > 0", "INFO", "'DKIM Signature Valid'", _DOM),
    ("hdr_dmarc_result < 0", "CRITICAL", "'DMARC Policy VIOLATED'", _DOM), ("hdr_dmarc_result = 0", "LOW", "'DMARC: Monitor-Only Policy (p=none)'", _DOM),
    ("hdr_from_reply_to_mismatch = 1", "HIGH", "'From ≠ Reply-To Domain Mismatch'", "'from=' || from_address || '; other=' || reply_to"),
    ("hdr_from_return_path_mismatch = 1", "MEDIUM", "'From ≠ Return-Path Domain Mismatch'", "'from=' || from_address || '; other=' || return_path"),
    ("hdr_reply_to_freemail = 1", "MEDIUM", "'Reply-To Uses Free Email Provider'", "reply_to"),
    ("hdr_received_hop_count > 6", "MEDIUM", "'Excessive Relay Chain (' || hdr_received_hop_count || ' hops)'", "hdr_received_hop_count::VARCHAR"),
    ("hdr_received_geo_anomaly = 1", "MEDIUM", "'Geographic Origin Anomaly'", "hdr_received_hop_count::VARCHAR"),
    ("hdr_x_mailer_suspicious = 1", "LOW", "'Suspicious X-Mailer / Sending Tool'", "x_mailer")], "hf_in"), "hf_in")


@query("SELECT mail_id, severity, title, detail FROM hf", "hf")
def header_findings(spark, d):
    p = parsed(spark, d)
    df = headers.header_features(p, keep=("mail_id", "from_address", "reply_to", "return_path", "x_mailer"))
    return findings.finding_rows(df.withColumn("f", findings.header_findings()), "f", "header").drop("area", "pos")


_FD = "lower(" + o.ext("from_address", "([a-zA-Z0-9_.%+-]+)@([a-zA-Z0-9_.-]+)", 2) + ")"
_SHOWN = "lower(" + o.sub(o.strip(o.ext("from_address", r"^(.+?)\s*<", 1)), '^"+|"+$', "") + ")"
o.cte("af_in", f"SELECT *, {_OFF('brand')} AS site FROM (SELECT mail_id, from_address, {_FD} AS fd, lower({o.ext('return_path', '([a-zA-Z0-9_.%+-]+)@([a-zA-Z0-9_.-]+)', 2)}) AS rp, {o.first_in(_SHOWN, L.BRAND_OFFICIAL)} AS brand, "
      f"{o.first_in('split_part(' + _FD + ', chr(46), 1)', L.BRAND_OFFICIAL)} AS insub, split_part({_FD}, '.', -2) || '.' || split_part({_FD}, '.', -1) AS root FROM mail)", "mail")
o.cte("af", _rows_sql([
    (f"fd IN ({o.values(L.FREEMAIL_FINDINGS)})", "MEDIUM", "'From: free mail'", "fd"), ("fd <> '' AND brand IS NOT NULL AND NOT ends_with(fd, site)", "CRITICAL", "'From: display name'", "brand || '|' || fd"),
    ("fd <> '' AND brand IS NOT NULL AND ends_with(fd, site)", "INFO", "'From: official domain'", "brand || '|' || fd"),
    (f"length(fd) - length(replace(fd, '.', '')) >= 2 AND insub IS NOT NULL AND NOT {o.any_in('root', L.BRAND_OFFICIAL)}", "HIGH", "'From: brand in sub-domain'", "insub || '|' || fd"),
    ("rp <> '' AND fd <> '' AND rp <> fd", "MEDIUM", "'Return-Path: other domain'", "rp")], "af_in"), "af_in")


@query("SELECT mail_id, severity, title, detail FROM af", "af")
def address_findings(spark, d):
    m = mail.mail_fields(fx.mail_raw(spark, d))
    return findings.finding_rows(findings.with_address_findings(m), "address_findings", "address").drop("area", "pos")


o.cte("xf", _rows_sql([
    ("html_external_form_action > 0", "CRITICAL", "'External Form Action — Direct Credential Harvester'", "'form'"),
    ("html_hidden_text_count > 0", "HIGH", "'Hidden Text Elements (' || html_hidden_text_count || ' found) — Filter Evasion'", "'hidden'"),
    ("html_base64_content_count > 0", "HIGH", "'Base64-Encoded Content (' || html_base64_content_count || ' instances) — Obfuscation'", "'base64'"),
    ("html_javascript_count > 2", "MEDIUM", "'JavaScript in Email Body (' || html_javascript_count || ' script blocks)'", "'script'"),
    ("html_link_domain_diversity > 0.75 AND html_total_links > 5", "MEDIUM", "'High Link Domain Diversity (' || round_even(html_link_domain_diversity * 100, 0)::INT || '% across ' || html_total_links || ' links)'", "'links'")],
    "mh_feat"), "mh_feat")


@query("SELECT mail_id, severity, title, detail FROM xf", "xf")
def html_findings(spark, d):
    df = html.html_features(parsed(spark, d)).withColumn("f", findings.html_findings())
    return findings.finding_rows(df, "f", "html").drop("area", "pos")


o.cte("ioc_dom_parts", o.domains_of("ioc_du", "url", o.netloc("url")), "ioc_du")
o.cte("ioc_ent", o.CTES["url_ent"][1].replace("FROM du", "FROM ioc_du"), "ioc_du")
o.cte("ioc_triage", o.CTES["triage"][1].replace("url_dom", "ioc_dom_parts").replace("url_ent", "ioc_ent"), "ioc_dom_parts", "ioc_ent")
o.cte("first_bad", "SELECT mail_id, arg_min(url, rn) AS bad FROM (SELECT mail_id, url, row_number() OVER (PARTITION BY mail_id ORDER BY encode(url)) AS rn FROM ioc_url) JOIN ioc_triage USING (url) WHERE severity_rank >= 3 GROUP BY mail_id", "ioc_url", "ioc_triage")


@query("SELECT mail_id, 'authentication failed' AS summary FROM hf WHERE severity = 'CRITICAL' UNION ALL SELECT mail_id, 'high-risk link: ' || bad FROM first_bad UNION ALL "
       "SELECT mail_id, 'sender poses as a brand' FROM af WHERE severity = 'CRITICAL' UNION ALL SELECT DISTINCT mail_id, 'credential form' FROM xf WHERE contains(lower(title), 'credential') OR contains(lower(title), 'form') UNION ALL "
       "SELECT mail_id, 'hidden text' FROM xf WHERE contains(lower(title), 'hidden') UNION ALL SELECT mail_id, 'urgent language: ' || round_even(txt_urgency_score_normalised * 100, 0)::INT || '%' FROM txt WHERE txt_urgency_score_normalised > 0.4",
       "hf", "first_bad", "af", "xf", "txt")
def summary_findings(spark, d):
    p = parsed(spark, d)
    df = features.scalar_features(p, keep=("mail_id", "from_address", "reply_to", "return_path", "x_mailer", "body_text", "body_html", "urls"))
    df = findings.with_address_findings(df).select("*", findings.header_findings().alias("header_findings"), findings.html_findings().alias("html_findings"),
                   urls.triaged_links(indicators.links()).alias("triage"))
    return rows.explode_values(df, ["mail_id"], findings.summary_findings(), "summary")


# --- verdicts -----------------------------------------------------------------------------

@query("SELECT mail_id, model, CASE WHEN prob >= 0.65 THEN 'PHISHING' WHEN prob >= 0.4 THEN 'UNCERTAIN' ELSE 'LEGITIMATE' END AS verdict FROM scored", "scored")
def verdict_ml(spark, d):
    return scored_mails(spark, d).select("mail_id", "model", verdict.ml_verdict(F.col("prob")).alias("verdict"))


o.cte("ai", """SELECT m.mail_id, CASE WHEN ok THEN coalesce(json_extract_string(answer, '$.is_phishing')::BOOLEAN, false)::INT ELSE -1 END AS ai_is_phishing,
    CASE WHEN ok THEN coalesce(json_extract_string(answer, '$.confidence')::DOUBLE, 0) ELSE -1 END AS ai_confidence, CASE WHEN ok THEN coalesce(json_extract_string(answer, '$.risk_level'), 'LOW') ELSE 'UNKNOWN' END AS ai_risk_level,
    CASE WHEN ok THEN json_extract_string(answer, '$.impersonated_brand') END AS ai_brand, CASE WHEN ok THEN coalesce(json_array_length(answer, '$.phishing_signals'), 0) ELSE 0 END::BIGINT AS ai_n_signals,
    CASE WHEN ok THEN coalesce(json_extract_string(answer, '$.recommended_action'), 'MONITOR') ELSE 'MONITOR' END AS ai_action
  FROM mail m LEFT JOIN (SELECT mail_id, CASE WHEN json_valid(answer) THEN answer END AS answer, json_valid(answer) AS ok FROM ai_answer) a USING (mail_id)""", "mail", "ai_answer")


@query("SELECT mail_id, ai_is_phishing, ai_confidence, ai_risk_level, coalesce(ai_brand, '') AS ai_brand, ai_n_signals, ai_action FROM ai", "ai")
def ai_verdict_parse(spark, d):
    ids = fx.mail_raw(spark, d).select("mail_id")
    return verdict.ai_answers(ids, snapshot(spark, lookups.AI_ANSWER, ids)).withColumn("ai_brand", F.coalesce("ai_brand", F.lit("")))


def _n(v: str) -> str:
    return "(" + " + ".join(f"({t}_verdict = '{v}')::INT" for t in reputation.TOOLS) + ")"


o.cte("cv1", f"""SELECT mail_id, prob, ai_is_phishing, ai_confidence, {', '.join(_TOOLS)}, {_n('MALICIOUS')} AS bad, {_n('SUSPICIOUS')} AS odd, {_n('CLEAN')} AS ok,
    (spf_result < 0)::INT + (dkim_result < 0)::INT + (dmarc_result < 0)::INT AS fails, (spf_result > 0)::INT + (dkim_result > 0)::INT + (dmarc_result > 0)::INT AS passes,
    CASE WHEN ai_is_phishing = 1 AND ai_confidence >= 0.65 THEN greatest(prob, prob + ai_confidence * 0.25) WHEN ai_is_phishing = 0 AND ai_confidence >= 0.8 THEN least(prob, prob - ai_confidence * 0.15) ELSE prob END AS a1
  FROM pscore JOIN tools USING (mail_id) JOIN auth USING (mail_id) JOIN ai USING (mail_id)""", "pscore", "tools", "auth", "ai")
o.cte("cv2", """SELECT *, CASE WHEN odd >= 2 THEN greatest(a2, 0.64) ELSE a2 END AS a3 FROM (SELECT *, CASE WHEN bad >= 1 THEN greatest(a1, 0.7 + least(0.4, 0.2 * bad)) ELSE a1 END::DOUBLE AS a2 FROM cv1)""", "cv1")
o.cte("cv3", """SELECT *, CASE WHEN ok >= 3 AND bad = 0 AND a3 < 0.65 THEN least(a3, 0.4 - (0.05 + 0.02 * greatest(0, ok - 3))) ELSE a3 END::DOUBLE AS a4, ok >= 3 AND bad = 0 AND a3 < 0.65 AS consensus FROM cv2""", "cv2")
o.cte("cv4", """SELECT *, CASE WHEN fails >= 2 THEN greatest(a4, prob + 0.08 * fails) WHEN passes >= 2 AND a4 < 0.65 AND vt_verdict <> 'MALICIOUS' AND gsb_verdict <> 'MALICIOUS' THEN least(a4, prob - 0.04 * passes) ELSE a4 END::DOUBLE AS a5,
    CASE WHEN fails >= 2 THEN 'Auth: ' || fails || ' failed' WHEN passes >= 2 AND a4 < 0.65 AND vt_verdict <> 'MALICIOUS' AND gsb_verdict <> 'MALICIOUS' THEN 'Auth: ' || passes || ' passed' END AS auth_reason FROM cv3""", "cv3")
o.cte("composite", f"""SELECT mail_id, adjusted AS adjusted_prob, CASE WHEN adjusted >= 0.65 THEN 'PHISHING' WHEN adjusted >= 0.4 THEN 'UNCERTAIN' ELSE 'LEGITIMATE' END AS verdict,
    concat_ws('; ', CASE WHEN ai_is_phishing = 1 AND ai_confidence >= 0.65 THEN 'AI: PHISHING ' || round_even(ai_confidence * 100, 0)::INT || '%' END,
      CASE WHEN ai_is_phishing = 0 AND ai_confidence >= 0.8 THEN 'AI: LEGITIMATE ' || round_even(ai_confidence * 100, 0)::INT || '%' END,
      {", ".join(f"CASE WHEN {t}_verdict = 'MALICIOUS' THEN 'TI: {t.upper()} MALICIOUS' END" for t in reputation.TOOLS)},
      CASE WHEN odd >= 2 THEN 'TI: ' || odd || ' SUSPICIOUS' END, CASE WHEN consensus THEN 'TI: ' || ok || ' CLEAN' END, auth_reason) AS reasons
  FROM (SELECT *, greatest(0.0, least(1.0, round(a5, 9))) AS adjusted FROM cv4)""", "cv4")


@query("SELECT mail_id, round(adjusted_prob, 6) AS adjusted_prob, verdict, reasons FROM composite", "composite")
def verdict_composite(spark, d):
    p = mail_table(spark, d)
    s = snapshots(spark, p)
    df = scoring.feature_table(p, s).withColumn("prob", fixed_probability())
    df = df.join(scoring.fraud_scores(p, s.fraud_rep), "mail_id", "left").fillna(-1)
    out = verdict.composite_verdict(reputation.tool_verdicts(verdict.ai_answers(df, s.ai_answers)))
    return out.select("mail_id", F.round("adjusted_prob", 6).alias("adjusted_prob"), "verdict", F.array_join("reasons", "; ").alias("reasons"))


def analysed(spark: SparkSession, d: str) -> DataFrame:
    p = mail_table(spark, d)
    return scoring.score_mails(p, snapshots(spark, p), fixed_probability)


@query("SELECT c.mail_id, round(p.prob, 4) AS prob, round(adjusted_prob, 6) AS adjusted_prob, verdict, reasons, coalesce(n_urls, 0)::BIGINT AS n_urls, coalesce(n_dom, 0)::BIGINT AS n_domains "
       "FROM composite c JOIN pscore p USING (mail_id) LEFT JOIN (SELECT mail_id, count(*) AS n_urls FROM ioc_url GROUP BY 1) u USING (mail_id) LEFT JOIN (SELECT mail_id, count(*) AS n_dom FROM ioc_dom GROUP BY 1) x USING (mail_id)",
       "composite", "pscore", "ioc_url", "ioc_dom")
def score_mails(spark, d):
    out = analysed(spark, d)
    return out.select("mail_id", "prob", F.round("adjusted_prob", 6).alias("adjusted_prob"), "verdict", F.array_join("reasons", "; ").alias("reasons"),
                      "n_urls", F.size("domains").alias("n_domains"))


def _centroid_sql() -> str:
    """The fitted linear rule between the class means as an expression over ``fit_terms``."""
    return "round(1 / (1 + exp(-((SELECT ln(any_value(n1)::DOUBLE / any_value(n0)) - sum(weight * (m1 + m0) / 2) FROM fit_terms) + " + " + ".join(
        f"(SELECT weight FROM fit_terms WHERE feature = {o.lit(c)}) * {c}" for c in _COEF) + "))), 4)"


o.cte("fit_terms", f"""SELECT feature, n1, n0, m1, m0, CASE WHEN n1 * v1 + n0 * v0 > 0 THEN (m1 - m0) / ((n1 * v1 + n0 * v0) / (n1 + n0)) ELSE 0 END AS weight FROM (
    SELECT feature, count_if(label = 1) AS n1, count_if(label <> 1) AS n0, avg(value) FILTER (label = 1) AS m1, avg(value) FILTER (label <> 1) AS m0,
      var_pop(value) FILTER (label = 1) AS v1, var_pop(value) FILTER (label <> 1) AS v0
    FROM (UNPIVOT (SELECT mail_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in _COEF)} FROM feat) ON {', '.join(_COEF)} INTO NAME feature VALUE value) JOIN (SELECT mail_id, label FROM mail) USING (mail_id) GROUP BY feature)""", "feat", "mail")


@query()
def score_mails_fitted(spark, d):
    """Fit a model on the mails' features, publish it, and score the mails with the published version."""
    p = mail_table(spark, d)
    table = written(features.scalar_features(p, keep=("mail_id", "label")))
    terms, intercept = learn.centroid_terms(table, _COEF)
    root = scratch(spark)
    registry.publish(spark.createDataFrame(terms, registry.TERMS), {"kind": registry.LINEAR, "intercept": intercept, "features": _COEF}, root, "centroid")
    model, record = registry.load(spark, root, "centroid")
    out = scoring.score_mails(p, snapshots(spark, p), lambda: F.round(registry.linear_probability(model, record), 4))
    return out.select("mail_id", "prob", F.round("adjusted_prob", 6).alias("adjusted_prob"), "verdict", F.array_join("reasons", "; ").alias("reasons"))


o.cte("fit_score", f"SELECT mail_id, {_centroid_sql()} AS prob FROM feat", "feat", "fit_terms")
ORACLES["score_mails_fitted"] = o.with_ctes("SELECT c.mail_id, p.prob, round(adjusted_prob, 6) AS adjusted_prob, verdict, reasons FROM composite c JOIN pscore p USING (mail_id)", "fit_score", "composite").replace(
    f"pscore AS (SELECT mail_id, {o.PROB} AS prob FROM feat)", "pscore AS (SELECT * FROM fit_score)")


@query()
def model_registry(spark, d):
    """Train and compare models, publish the best, and score the rows with the published tables next to the fitted pipeline."""
    data, names = training(spark, d), [f"v{i}" for i in range(64)]
    fitted, scores, best = learn.train_all(data, ["lr", "rf"])
    root = scratch(spark)
    for name in scores:
        registry.publish_model(fitted[name], names, root, name, {"model": name, "scores": scores})
    plain = data.select("mail_id", *[vector_to_array("features")[i].alias(n) for i, n in enumerate(names)])
    out = None
    for name in scores:
        table, record = registry.load(spark, root, name)
        both = registry.scored(plain, table, record).join(learn.score(fitted[name], data).withColumnRenamed("prob", "direct"), "mail_id")
        row = both.agg(F.lit(name).alias("model"), F.lit(name == best).alias("best"), F.lit(record["version"]).alias("version"), F.lit(record["kind"]).alias("kind"),
                       F.lit(round(scores[name]["cv_f1_mean"], 6)).alias("cv_f1_mean"), F.count("*").alias("n_rows"), (F.max(F.abs(F.col("prob") - F.col("direct"))) < 1e-9).alias("agrees"))
        out = row if out is None else out.unionByName(row)
    return out


# --- exports ------------------------------------------------------------------------------

@query("SELECT mail_id, CASE ioc_type WHEN 'email' THEN 'email-src' WHEN 'ip' THEN 'ip-src' WHEN 'hash' THEN 'sha256' ELSE ioc_type END AS type, value FROM ioc_all", "ioc_all")
def export_misp_attributes(spark, d):
    arrays = indicators.indicator_arrays(parsed(spark, d))
    return rows.explode_structs(exports.event_attributes(arrays), ["mail_id"], F.col("attributes"), "type").select("mail_id", "type", "value")


o.cte("event_attribute", "SELECT mail_id, rank, value, CASE rank WHEN 0 THEN 'email-src' WHEN 1 THEN 'ip-src' WHEN 2 THEN 'url' WHEN 3 THEN 'domain' ELSE 'sha256' END AS type, "
      "['Payload delivery', 'Network activity', 'External analysis', 'Network activity', 'Payload delivery'][rank + 1] AS category, "
      "['sender address', 'relay address', 'link', 'link domain', 'attachment'][rank + 1] AS comment "
      "FROM (SELECT mail_id, value, list_position(['email', 'ip', 'url', 'domain', 'hash'], ioc_type) - 1 AS rank FROM ioc_all)", "ioc_all")


@query("SELECT m.mail_id, to_json({'Event': {'info': 'mailquarry detection', 'date': '" + STAMP[:10] + "', 'threat_level_id': '2', 'analysis': '1', 'distribution': '0', "
       "'Attribute': coalesce(a, []), 'Tag': [{'name': 'phishing'}, {'name': 'mailquarry'}]}})::VARCHAR AS event FROM mail m LEFT JOIN ("
       "SELECT mail_id, list({'type': type, 'category': category, 'value': value, 'comment': comment, 'to_ids': true} ORDER BY rank, encode(value)) AS a FROM event_attribute GROUP BY mail_id) USING (mail_id)",
       "mail", "event_attribute")
def export_misp(spark, d):
    return exports.misp_json(indicators.indicator_arrays(parsed(spark, d)), STAMP)


o.cte("ioc_min", "SELECT mail_id, " + ", ".join(f"arg_min(CASE WHEN ioc_type = '{t}' THEN value END, CASE WHEN ioc_type = '{t}' THEN encode(value) END) AS first_{t}, count_if(ioc_type = '{t}') AS n_{t}" for t in ("email", "ip", "url", "domain"))
      + " FROM ioc_all GROUP BY mail_id", "ioc_all")


@query(f"SELECT m.mail_id, 'CEF:0|mailquarry|mailquarry|1.0|phishing_detection|PHISHING|10|rt={STAMP} src=' || coalesce(first_ip, 'unknown') || ' suser=' || coalesce(first_email, 'unknown') || ' cnt=' || coalesce(n_url, 0)::BIGINT || "
       "' domainCount=' || coalesce(n_domain, 0)::BIGINT || ' rawEmailHash=' || sha256(raw_email) || ' verdict=PHISHING' AS line FROM mail m LEFT JOIN ioc_min USING (mail_id)", "mail", "ioc_min")
def export_cef(spark, d):
    arrays = indicators.indicator_arrays(parsed(spark, d)).withColumn("verdict", F.lit("PHISHING"))
    return exports.cef_lines(arrays, STAMP)


def _section(title: str, kind: str) -> str:
    return (f"chr(10) || '  {title}  (' || coalesce(n_{kind}, 0)::BIGINT || ' found)' || chr(10) || '  ' || repeat('─', 40) || chr(10) || coalesce(t_{kind}, '    (none)')")


@query("SELECT m.mail_id, concat_ws(chr(10), repeat('═', 60), '  Indicator report', '  Generated : " + STAMP + "', '  Risk Score: 50.0%', repeat('═', 60), "
       + ", ".join(_section(t, k) for t, k in (("Sender Email Addresses", "email"), ("Sender IPs", "ip"), ("URLs", "url"), ("Domains", "domain")))
       + ", chr(10) || '  Raw Email SHA-256: ' || sha256(raw_email), repeat('═', 60)) AS report FROM mail m LEFT JOIN (SELECT mail_id, "
       + ", ".join(f"count_if(ioc_type = '{k}') AS n_{k}, string_agg('    ' || value, chr(10) ORDER BY encode(value)) FILTER (WHERE ioc_type = '{k}') AS t_{k}" for k in ("email", "ip", "url", "domain"))
       + " FROM ioc_all GROUP BY mail_id) USING (mail_id)", "mail", "ioc_all")
def export_text(spark, d):
    return exports.text_summary(indicators.indicator_arrays(parsed(spark, d)).withColumn("prob", F.lit(0.5)), STAMP)


_NAME = "CASE technique_id " + " ".join(f"WHEN '{t}' THEN '{v[0]}'" for t, v in {**L.TECHNIQUES, **{x[0]: (x[1], x[2]) for x in L.FEATURE_TECHNIQUES.values() if x[0] not in L.TECHNIQUES}}.items()) + " END"
_EV = {
    "T1566": f"'ml_probability=' || {o._PCT1}", "T1566.001": "'attachment_count=' || n_attachments", "T1566.002": "'url_count=' || n_urls",
    "T1036": "concat_ws(', ', CASE WHEN url_brand_in_subdomain_max > 0 THEN 'brand_in_subdomain=True' END, CASE WHEN url_cert_brand_mismatch > 0 THEN 'cert_brand_mismatch=True' END, CASE WHEN url_punycode_detected_max > 0 THEN 'punycode_domain=True' END)",
    "T1204": "'urgency_score=' || printf('%.3f', txt_urgency_score_normalised)", "T1056": "'external_form_action=True'",
    "T1027": "concat_ws(', ', CASE WHEN html_base64_content_count > 0 THEN 'base64_html_content=True' END, CASE WHEN html_hidden_text_count > 0 THEN 'hidden_text=True' END, CASE WHEN html_javascript_count > 2 THEN 'javascript_obfuscation=True' END, CASE WHEN url_url_entropy_max > 4.5 THEN 'high_url_entropy=True' END)",
    "T1078": "'suspicious_url_keywords=' || url_suspicious_keywords_in_url_max::INT",
    "T1071.003": "concat_ws(', ', CASE WHEN hdr_spf_result < 0 THEN 'spf_fail=True' END, CASE WHEN hdr_dkim_result < 0 THEN 'dkim_fail=True' END, CASE WHEN hdr_dmarc_result < 0 THEN 'dmarc_fail=True' END)",
    "T1598": "'external_form_action=True, suspicious_url_keywords=True'", "T1539": "'external_form_action=True, high_urgency=True'",
}
_ORD = ["T1566", "T1566.001", "T1566.002", "T1036", "T1204", "T1056", "T1027", "T1078", "T1071.003", "T1598", "T1539"]
_ORD_SQL = ("CASE WHEN c.mail_id IS NULL THEN CASE technique_id " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(_ORD)) + " END ELSE CASE feature "
            + " ".join(f"WHEN '{f}' THEN {20 + i}" for i, f in enumerate(L.FEATURE_TECHNIQUES)) + " END END")
o.cte("map_hit", "SELECT mail_id, technique_id, arg_min(feature, i) AS feature, arg_min(v, i) AS v FROM (" + " UNION ALL ".join(
    f"SELECT mail_id, '{v[0]}' AS technique_id, '{f}' AS feature, {f}::DOUBLE AS v, {i} AS i FROM rule_in WHERE {f} > 0" for i, (f, v) in enumerate(L.FEATURE_TECHNIQUES.items())) + ") GROUP BY 1, 2", "rule_in")
o.cte("technique_text", f"""SELECT k.mail_id, {_ORD_SQL} AS ord, chr(10) || '[' || technique_id || '] ' || CASE WHEN c.mail_id IS NULL THEN {_NAME} ELSE CASE feature {" ".join(f"WHEN '{f}' THEN '{v[1]}'" for f, v in L.FEATURE_TECHNIQUES.items())} END END
    || chr(10) || '  Tactic:     ' || {_TACTIC} || chr(10) || '  Confidence: ' || repeat('█', floor(confidence * 10)::INT) || ' ' || round_even(confidence * 100, 0)::INT || '%' || chr(10) || '  Evidence:   '
    || CASE WHEN c.mail_id IS NULL THEN CASE technique_id {" ".join(f"WHEN '{t}' THEN {e}" for t, e in _EV.items())} END ELSE feature || '=' || v::VARCHAR END || chr(10) || '  Reference:  https://attack.mitre.org/techniques/' || replace(technique_id, '.', '/') || '/' AS block
  FROM technique_kept k JOIN rule_in USING (mail_id) LEFT JOIN map_hit USING (mail_id, technique_id) LEFT JOIN config_row c USING (mail_id, technique_id)""", "technique_kept", "rule_in", "map_hit", "config_row")


@query("SELECT m.mail_id, CASE WHEN t IS NULL THEN 'No ATT&CK techniques mapped (email classified as legitimate).' ELSE 'MITRE ATT&CK Technique Mapping' || chr(10) || repeat('=', 40) || chr(10) || t END AS report "
       "FROM mail m LEFT JOIN (SELECT mail_id, string_agg(block, chr(10) ORDER BY ord) AS t FROM technique_text GROUP BY mail_id) x USING (mail_id)", "mail", "technique_text")
def export_attack_text(spark, d):
    return exports.technique_report(techniques.calibrate(techniques.with_techniques(_technique_input(spark, d))))


@query()
def export_report(spark, d):
    return exports.analysis_report(analysed(spark, d).withColumn("source", F.lit("batch")))
