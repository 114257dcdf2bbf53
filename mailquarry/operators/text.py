"""Text features: urgency, subject line, TF-IDF and dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lists as L
from mailquarry.functions import rows as R
from mailquarry.functions import text as X
from mailquarry.plans.staging import written


def urgency_columns(text: Column) -> dict[str, Column]:
    """Share (phrases per 100 words, at most 1) and number of urgency phrases in a text."""
    count = X.count_present(F.lower(text), L.URGENCY_PHRASES)
    words = F.greatest(X.word_count(text), F.lit(1))
    return {"urgency_score_normalised": F.least(count / (words / F.lit(100.0)), F.lit(1.0)),
            "urgency_phrase_count": count}


def subject_columns(subject: Column) -> dict[str, Column]:
    low = F.lower(subject)
    words = X.words(subject)
    shouted = F.filter(words, lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))
    counted = {"exclamation": "!", "question": r"\?", "dollar": r"\$"}
    n = {k: F.regexp_count(subject, F.lit(p)) for k, p in counted.items()}
    return {
        "subject_length": F.length(subject),
        "subject_exclamation_count": n["exclamation"],
        "subject_question_count": n["question"],
        "subject_caps_ratio": F.size(shouted) / F.greatest(F.size(words), F.lit(1)),
        "subject_spoofed_re_fw": subject.rlike("(?i)^(?:re:|fw:|fwd:)").cast("int"),
        "subject_brand_keyword": X.contains_any(low, dict.fromkeys(L.BRANDS)).cast("int"),
        "subject_urgency_keyword": X.contains_any(low, L.SUBJECT_URGENCY).cast("int"),
        "subject_dollar_count": n["dollar"],
    }


def text_features(mail: DataFrame, text: str = "body_text", keep: tuple[str, ...] = ("mail_id",)) -> DataFrame:
    """``txt_*`` columns from the text part and the subject."""
    cols = {**urgency_columns(F.col(text)), **subject_columns(F.col("subject"))}
    return mail.select(*keep, *[cols[n].alias(f"txt_{n}") for n in L.TEXT_FEATURES])


def truncate_words(c: Column, n: int = L.EMBEDDING_WORDS) -> Column:
    """First ``n`` words joined by blanks; a shorter text is unchanged. The rest of a text is not taken apart."""
    w = X.first_words(c, n)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(c)


# --- TF-IDF -------------------------------------------------------------------------------

def terms(text: Column) -> Column:
    """Lower-case, accent-free words of two or more characters, and pairs of neighbouring words."""
    return F.regexp_extract_all(X.strip_accents(F.lower(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def _pairs(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1),
                                    lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def _with_pairs(words: Column) -> Column:
    return F.concat(words, _pairs(words))


def doc_terms(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, terms``: all words and word pairs of each document, with repeats."""
    words = docs.select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("_w"))
    return words.select("doc_id", _with_pairs(F.col("_w")).alias("terms"))


BUCKETS = 1024
KNOWN_WORDS = 5000          # what is looked up in the row ends here; with more words of equal rank all pairs are counted


def _counted(docs: DataFrame, values: str) -> DataFrame:
    """``term, tf, df`` of an array column: each row gives its values, then its distinct values, combined before the shuffle."""
    one = lambda c: F.sum(c.cast("bigint"))
    each = docs.select(F.size(values).alias("_n"), F.posexplode_outer(F.concat(values, F.array_distinct(values))).alias("_p", "term")).where("_p IS NOT NULL")
    return each.groupBy("term").agg(one(F.col("_p") < F.col("_n")).alias("tf"), one(F.col("_p") >= F.col("_n")).alias("df"))


def _known(words: DataFrame):
    """A function of a word: itself if it is one of ``words``, else NULL; the words are a hash table in one literal."""
    table: list[list[str]] = [[] for _ in range(BUCKETS)]
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
    for r in words.select("term", place(F.col("term")).alias("at")).collect():          # at most KNOWN_WORDS rows
        table[r["at"]].append(r["term"])
    literal = "array(" + ", ".join("array(" + ", ".join(f"'{w}'" for w in b or [""]) + ")" for b in table) + ")"         # words have no quotes
    return lambda w: F.when(F.array_contains(F.get(F.expr(literal), place(w)), w), w)


def tfidf_vocabulary(docs: DataFrame, doc_id: str, text: str, size: int = L.TFIDF_TERMS, min_df: int = 2) -> DataFrame:
    """``term, tf, df, idf``: the most frequent terms found in at least ``min_df`` documents.

    Words are counted first. A pair is never more frequent than either of its words, so only pairs whose words both reach the
    ``size``-th word in frequency can be in the vocabulary; the others are left out in the row, and the pairs that are counted are
    bounded by the square of these words, not by the texts. Ties in frequency go to the smaller term.
    """
    words = docs.select(terms(F.col(text)).alias("_w"))
    single = written(_counted(words, "_w").where(F.col("df") >= min_df))
    head = single.orderBy(F.desc("tf"), "term").limit(size).agg(F.count("*").alias("n"), F.min("tf").alias("tf")).first()
    least = head["tf"] if size and head["n"] == size else 0
    frequent = single.where(F.col("tf") >= least)
    if frequent.count() <= KNOWN_WORDS:
        known = _known(frequent)
        words = words.select(F.transform("_w", known).alias("_w"))
    pairs = words.select(F.array_compact(_pairs(F.col("_w"))).alias("_w"))
    counts = frequent.unionByName(_counted(pairs, "_w").where((F.col("df") >= min_df) & (F.col("tf") >= least)))
    top = counts.orderBy(F.desc("tf"), "term").limit(size)
    n_docs = docs.agg(F.count("*").alias("_n"))
    return (top.join(F.broadcast(n_docs))
            .select("term", "tf", "df", (F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1).alias("idf")))


def tfidf_weights(docs: DataFrame, doc_id: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """``doc_id, term, weight``: (1 + ln tf) * idf with unit row length, for terms of the vocabulary.

    The vocabulary has a fixed size, so it is broadcast; all other terms are dropped before the shuffle.
    """
    vocabulary = written(vocabulary.select("term", "idf"))
    words = docs.select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("_w"))
    found = words.select("doc_id", _with_pairs(F.col("_w")).alias("terms"))
    if vocabulary.count() <= KNOWN_WORDS:               # other terms go in the row
        parts = vocabulary.select(F.explode(F.split("term", " ")).alias("term")).distinct()
        words = words.select("doc_id", F.transform("_w", _known(parts)).alias("_w"))
        kept = words.select("doc_id", F.array_compact(_with_pairs(F.col("_w"))).alias("terms"))
        found = kept.select("doc_id", F.array_compact(F.transform("terms", _known(vocabulary))).alias("terms"))
    hits = (R.explode_values(found, ["doc_id"], "terms", "term").join(F.broadcast(vocabulary), "term")
            .groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("idf").alias("idf"))
            .select("doc_id", "term", ((F.log(F.col("tf").cast("double")) + 1) * F.col("idf")).alias("w")))
    # At most one row per vocabulary term and document, so a document is a bounded group here.
    norms = hits.groupBy("doc_id").agg(F.collect_list(F.struct("term", "w")).alias("_t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return (norms.select("doc_id", "_norm", F.inline("_t"))
            .select("doc_id", "term", (F.col("w") / F.col("_norm")).alias("weight")))


# --- dense vectors ------------------------------------------------------------------------

def attach_embeddings(mails: DataFrame, vectors: DataFrame, dim: int = L.EMBEDDING_DIM) -> DataFrame:
    """Join stored vectors ``(mail_id, embedding)``; mails without one get zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return (mails.join(vectors.select("mail_id", "embedding"), "mail_id", "left")
            .withColumn("embedding", F.coalesce("embedding", zeros)))
