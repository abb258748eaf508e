"""Top-k retrieval: lexical, dense, BM25 and hybrid by reciprocal ranks. Every order has an explicit tie-break."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import DEFAULTS
from folioforge.functions.scores import cosine
from folioforge.functions.text import query_terms
from folioforge.operators.nearest import nearest, no_group

#: Answers of the extractive composer.
REFUSAL = "No evidence was found in the documents."


def parse_search_request(query: object, document_ids: Sequence[str] | None = None, folder_id: str | None = None, top_k: object = 8) -> dict:
    """A checked request: query of 1 to 2000 characters once trimmed, at most 20 distinct ids, top_k within 1 and 20."""
    uuid = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", re.IGNORECASE)
    if not isinstance(query, str) or not 1 <= len(query.strip()) <= 2000:
        raise ValueError("the query must have 1 to 2000 characters")
    ids = None if document_ids is None else list(dict.fromkeys(document_ids))
    if ids is not None and (len(ids) > 20 or not all(isinstance(x, str) and uuid.fullmatch(x) for x in ids)):
        raise ValueError("at most 20 document ids are allowed, each a UUID")
    if folder_id is not None and not uuid.fullmatch(folder_id):
        raise ValueError("the folder id must be a UUID")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 20:
        raise ValueError("top_k must be an integer from 1 to 20")
    return {"query": query.strip(), "document_ids": ids, "folder_id": folder_id, "top_k": top_k}


def clamp_top_k(k: int | None, default: int = 6) -> int:
    return default if k is None else max(1, min(20, int(k)))


# --- lexical ----------------------------------------------------------------------------------------------------


def lexical_scores(chunks: DataFrame, query: str) -> DataFrame:
    """chunks(title, heading_path, text, ...) with `matched` terms and `score`; rows without a match are dropped.

    Terms match as substrings of title, headings and text. The score is the share of terms that match, plus 0.2
    once if a term stands in the title, at most 0.99.
    """
    terms = chunks.sparkSession.range(1).select(query_terms(F.lit(query)).alias("t")).first().t  # the query's own terms
    if not terms:
        return chunks.limit(0).withColumn("matched", F.lit(0)).withColumn("score", F.lit(0.0))
    title = F.lower(F.coalesce("title", F.lit("")))
    body = F.lower(F.concat_ws(" ", "title", F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " "), "text"))
    hits = sum((body.contains(t).cast("int") for t in terms), F.lit(0))
    bonus = F.when(_any([title.contains(t) for t in terms]), 0.2).otherwise(0.0)
    rows = chunks.withColumn("matched", hits).where("matched > 0")
    return rows.withColumn("score", F.least(F.lit(0.99), F.col("matched") / len(terms) + bonus))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def lexical_search(chunks: DataFrame, query: str, limit: int = 4, ties: Sequence[str] = ("document_id", "ordinal")) -> DataFrame:
    """The best chunks; documents that are being deleted are skipped where a status is given."""
    if limit < 1:
        return lexical_scores(chunks, query).limit(0)
    rows = chunks.where("status IS NULL OR status <> 'deleting'") if "status" in chunks.columns else chunks
    return lexical_scores(rows, query).orderBy(F.col("score").desc(), *ties).limit(limit)


def extractive_answer(hits: DataFrame) -> DataFrame:
    """(answer): the best hit with its place and the number of sources, or the refusal. Of equal scores the first in the search's order is best."""
    ties = [c for c in ("document_id", "ordinal", "chunk_id") if c in hits.columns]
    best = hits.agg(F.min_by(F.struct("title", "text"), F.struct((-F.col("score")).alias("_s"), *ties)).alias("b"), F.count(F.lit(1)).alias("n"))
    said = F.format_string("[%s] %s (%d sources)", F.col("b.title"), F.col("b.text"), F.col("n"))
    return best.select(F.when(F.col("n") > 0, said).otherwise(REFUSAL).alias("answer"))


# --- dense ------------------------------------------------------------------------------------------------------


def dense_search(vectors: DataFrame, query: Sequence[float], k: int = 10, least: float | None = None, vector: str = "embedding", tie: str = "chunk_id") -> DataFrame:
    """The k rows of highest cosine with the query vector, with `score`; optionally only from a threshold on."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.withColumn("score", cosine(F.col(vector), q)).where("score IS NOT NULL")
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    return rows.orderBy(F.col("score").desc(), tie).limit(k)


def dense_topk_join(queries: DataFrame, vectors: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors (id, embedding) of each query (query_id, embedding), ids being longs."""
    q = queries.select(F.col("query_id").alias("id"), no_group(), F.col("embedding").alias("vector"))
    v = vectors.select("id", no_group(), F.col("embedding").alias("vector"))
    return nearest(q, v, k, least).select("query_id", "id", "score", "rank")


def check_vectors(vectors: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """The rows unchanged; running the plan fails on a vector of another size."""
    wrong = F.size(column) != size
    return vectors.withColumn(column, F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit(f"a vector does not have {size} components"))).otherwise(F.col(column)))


# --- BM25 -------------------------------------------------------------------------------------------------------


#: Scripts that are written without blanks.
_WIDE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
#: Where these and Hangul lie; looking up the script of every character takes much longer.
_FAR = r"[\x{1100}-\x{11FF}\x{2E80}-\x{10FFFF}]"
#: Korean particles that follow a noun, longer ones first.
_PARTICLES = "에서는|에게서|으로는|에서|에게|으로|까지|부터|보다|처럼|에는|은|는|이|가|을|를|의|에|로|와|과|도|만"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits. Han and Kana become overlapping pairs; a Korean word comes with its stem beside it, where a particle follows."""
    low = F.lower(text)
    plain = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.when(low.rlike(_FAR) & low.rlike(rf"[{_WIDE}\p{{IsHangul}}]"), F.flatten(F.transform(plain, _segments))).otherwise(plain)


def _segments(word: Column) -> Column:
    runs = F.regexp_extract_all(word, F.lit(f"[{_WIDE}]+|[^{_WIDE}]+"), 0)
    pairs = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array(r))
    stem = lambda r: F.regexp_replace(r, rf"^(\p{{IsHangul}}{{2,}}?)(?:{_PARTICLES})$", "$1")
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{_WIDE}]"), pairs(r)).otherwise(F.array_distinct(F.array(r, stem(r))))))


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text", query: str | None = None) -> DataFrame:
    """(key, term, tf, len) of an index; with a query only of its terms, counted row by row without a shuffle."""
    rows = chunks.select(key, tokens(F.col(text)).alias("_t")).withColumn("len", F.size("_t"))
    if query is not None:
        terms = chunks.sparkSession.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t")).first().t  # the query's own terms
        counted = [F.struct(F.lit(t).alias("term"), _occurrences(t).alias("tf")) for t in terms]
        if not counted:
            return rows.limit(0).select(key, F.lit("").alias("term"), F.lit(0).cast("long").alias("tf"), "len")
        return rows.select(key, "len", F.explode(F.array(*counted)).alias("c")).select(key, "c.term", "c.tf", "len").where("tf > 0")
    return rows.select(key, "len", F.explode_outer("_t").alias("term")).where("term IS NOT NULL").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("_t", lambda x: x == term)).cast("long")


def bm25_search(index: DataFrame, documents: int | DataFrame, query: str, k: int = 10, key: str = "chunk_id", settings=DEFAULTS) -> DataFrame:
    """(key, score) of the k best. `documents`: the number of indexed texts, or the texts."""
    n = documents if isinstance(documents, int) else documents.count()
    terms = index.sparkSession.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("term"))
    hits = index.join(F.broadcast(terms), "term")  # one row per term of the query
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = settings.bm25_k1 * (1 - settings.bm25_b + settings.bm25_b * F.col("len") / settings.bm25_avg_len)
    weight = F.col("tf") * (settings.bm25_k1 + 1) / (F.col("tf") + norm)
    scored = hits.join(F.broadcast(df.select("term", idf.alias("idf"))), "term").groupBy(key).agg(F.sum(F.col("idf") * weight).alias("score"))
    # Sums of the same terms may differ in their last bits; such scores are ties.
    return scored.orderBy(F.round("score", 9).desc(), key).limit(k)


# --- hybrid -----------------------------------------------------------------------------------------------------


def arm_limit(k: int) -> int:
    return max(3 * k, 20)


def ranked(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, rank0) of a hit list that a limit bounds."""
    return hits.withColumn("rank0", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), key)) - 1).select(key, "rank0")


def rrf_fuse(arms: Sequence[DataFrame], k: int, least: float = 0.0, constant: int = DEFAULTS.rrf_k, key: str = "chunk_id") -> DataFrame:
    """(key, score): sums of 1 / (constant + rank from 0) over the arms' (key, rank0), from the threshold on."""
    every = arms[0].select(key, "rank0")
    for arm in arms[1:]:
        every = every.unionByName(arm.select(key, "rank0"))
    fused = every.groupBy(key).agg(F.sum(F.lit(1.0) / (constant + F.col("rank0"))).alias("score"))
    return fused.where(F.col("score") >= least).orderBy(F.round("score", 9).desc(), key).limit(k)


def hybrid_search(
    vectors: DataFrame, index: DataFrame, documents: int, query_vector: Sequence[float], query: str, k: int = 10, least: float = 0.0, key: str = "chunk_id", settings=DEFAULTS
) -> DataFrame:
    """Dense and BM25 arms over the same rows, fused. The dense arm may be asked with another text than BM25 is."""
    if not query.strip():
        raise ValueError("the query must not be empty")
    n = arm_limit(k)
    dense = ranked(dense_search(vectors, query_vector, n, tie=key), key)
    sparse = ranked(bm25_search(index, documents, query, n, key, settings), key)
    return rrf_fuse([dense, sparse], k, least, settings.rrf_k, key)


def without(rows: DataFrame, excluded: DataFrame | None, key: str) -> DataFrame:
    """The rows whose key is not among excluded(key)."""
    return rows if excluded is None else rows.join(excluded.select(key).distinct(), key, "left_anti")


def rule_search(rules: DataFrame, query_vector: Sequence[float], query: str, k: int = 6, excluded: DataFrame | None = None, settings=DEFAULTS) -> DataFrame:
    """(rule_id, score, rank) of the k best rules(rule_id, statement, embedding) by both arms, without excluded(rule_id); no threshold."""
    rows = without(rules, excluded, "rule_id")
    texts = rows.select("rule_id", F.col("statement").alias("text"))
    hits = hybrid_search(rows, postings(texts, "rule_id", query=query), texts.count(), query_vector, query, k, 0.0, "rule_id", settings)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "rule_id")) - 1)  # k rows


def similar_rules(rules: DataFrame, query_vector: Sequence[float], k: int = 5, least: float = 0.35, excluded: DataFrame | None = None) -> DataFrame:
    """(rule_id, score) of the k nearest rules from the threshold on, without excluded(rule_id)."""
    return dense_search(without(rules, excluded, "rule_id"), query_vector, k, least, tie="rule_id").select("rule_id", "score")


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: hashed counts of tokens, scaled to length 1."""
    slots = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)).cast("float"))
