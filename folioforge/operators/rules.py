"""Business rules: candidate checks, bindings to documents, links between rules, reach."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import DEFAULTS
from folioforge.functions.scores import calibrated, raw_threshold
from folioforge.functions.text import trimmed
from folioforge.operators.retrieval import dense_topk_join


def find_span(text: str | None, phrase: str | None) -> tuple[str, int, int] | None:
    """(found text, start, end) of a phrase: as it is, composed, decomposed, then with any white space between words."""
    phrase = (phrase or "").strip()
    if not text or not phrase:
        return None
    forms = list(dict.fromkeys((phrase, unicodedata.normalize("NFC", phrase), unicodedata.normalize("NFD", phrase))))
    for form in forms:
        if (at := text.find(form)) >= 0:
            return form, at, at + len(form)
    for form in forms:
        words = form.split()
        if len(words) > 1 and (m := re.search(r"\s+".join(map(re.escape, words)), text)):
            return m[0], m.start(), m.end()
    return None


#: What Python and ECMAScript do not both strip; phrases with these at an end are left to Python.
_ODD_ENDS = "(?s)^[\\x1c-\\x1f\\x85\\ufeff]|[\\x1c-\\x1f\\x85\\ufeff]$"


def exact_spans(rows: DataFrame, text: str = "text", phrase: str = "phrase") -> DataFrame:
    """rows with found, start_offset, end_offset (null: not found). Only phrases that are not there as they are go through Python."""
    span = "found string, start_offset int, end_offset int"

    @F.pandas_udf(f"struct<{span.replace(' ', ':')}>".replace(",:", ","))
    def other_forms(texts: pd.Series, phrases: pd.Series) -> pd.DataFrame:
        spans = [find_span(t, p) or (None, None, None) for t, p in zip(texts, phrases, strict=True)]
        return pd.DataFrame({"found": [s[0] for s in spans], "start_offset": pd.array([s[1] for s in spans], dtype="Int32"), "end_offset": pd.array([s[2] for s in spans], dtype="Int32")})

    words = trimmed(F.col(phrase))
    at = F.when((words != "") & ~F.col(phrase).rlike(_ODD_ENDS), F.instr(F.col(text), words)).otherwise(0)
    there = F.coalesce(at, F.lit(0)) > 0
    as_is = F.struct(words.alias("found"), (at - 1).cast("int").alias("start_offset"), (at - 1 + F.length(words)).cast("int").alias("end_offset"))
    left = lambda c: F.when(~there, F.col(c))
    return rows.withColumn("_span", F.when(there, as_is).otherwise(other_forms(left(text), left(phrase)))).select(*rows.columns, "_span.*")


def normal_form(text):
    """Column: composed form in lower case, by which statements are told apart."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).strip().lower())

    return nfc(text)


def validate_candidates(candidates: DataFrame, chunks: DataFrame, settings=DEFAULTS) -> DataFrame:
    """candidates(document_id, position, source_chunk_id, statement, evidence_quote, confidence) with offsets and `reason`.

    reason is null for the accepted ones, which get their `ordinal`: the chunk must exist, confidence reach 0.6,
    lengths stay within bounds, the quote stand in the chunk, the statement be the first of its kind, and not
    more than 100 come from one document. Limits of None are none.
    """
    found = chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.col("text").alias("_text"), F.lit(True).alias("_there"))
    rows = candidates.join(found, "source_chunk_id", "left")
    rows = exact_spans(rows, "_text", "evidence_quote")
    beyond = lambda size, most: F.lit(False) if most is None else size > most
    reason = (
        F.when(F.coalesce(F.trim("statement"), F.lit("")) == "", "statement")
        .when(beyond(F.length("statement"), settings.max_statement), "statement")
        .when(F.coalesce(F.trim("evidence_quote"), F.lit("")) == "", "quote")
        .when(F.length("evidence_quote") > settings.max_quote, "quote")
        .when(F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") < settings.min_confidence) | (F.col("confidence") > 1), "confidence")
        .when(F.col("_there").isNull(), "chunk")
        .when(F.col("found").isNull(), "evidence")
    )
    rows = rows.withColumn("reason", reason).withColumn("_form", normal_form(F.col("statement")))
    same = Window.partitionBy("document_id", "_form", F.col("reason").isNull()).orderBy("position")
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(same) > 1), "duplicate").otherwise(F.col("reason")))
    order = Window.partitionBy("document_id", F.col("reason").isNull()).orderBy("position")
    rows = rows.withColumn("ordinal", F.when(F.col("reason").isNull(), F.row_number().over(order) - 1))
    rows = rows.withColumn("reason", F.when(beyond(F.col("ordinal") + 1, settings.max_rules), "limit").otherwise(F.col("reason")))
    return rows.withColumn("ordinal", F.when(F.col("reason").isNull(), F.col("ordinal"))).drop("_text", "_there", "_form")


def manual_rule(contents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, source_chunk_id, statement, start_offset, end_offset, confidence): the rule a document of one rule holds.

    contents(document_id, content); the first chunk with the exact text places it.
    """
    rows = chunks.join(contents, "document_id")
    spans = exact_spans(rows.select("document_id", "ordinal", F.col("chunk_id").alias("source_chunk_id"), "text", F.col("content").alias("statement")), "text", "statement").where("found IS NOT NULL")
    first = spans.withColumn("_r", F.row_number().over(Window.partitionBy("document_id").orderBy("ordinal"))).where("_r = 1")
    return first.select("document_id", "source_chunk_id", "statement", "start_offset", "end_offset", F.lit(1.0).alias("confidence"))


def bindings(rules: DataFrame, chunks: DataFrame, least: float = DEFAULTS.binding_threshold, model: str | None = None, settings=DEFAULTS) -> DataFrame:
    """(rule_id, document_id, chunk_id, vector_score): for each rule its best chunk of each document, at most 20 documents.

    rules(rule_id, embedding); chunks(chunk_id, document_id, embedding, text) of latest versions. The 40 nearest
    chunks above the threshold are candidates.
    """
    raw = F.lit(least) if model is None else raw_threshold(F.lit(least), model)
    hits = dense_topk_join(rules.select(F.col("rule_id").alias("query_id"), "embedding"), chunks.select(F.col("chunk_id").alias("id"), "embedding"), settings.binding_candidates)
    hits = hits.where(F.col("score") >= raw).join(chunks.where(F.trim("text") != "").select(F.col("chunk_id").alias("id"), "document_id"), "id")
    first = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("rank"))).where("_r = 1")
    kept = first.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_r") <= settings.max_bindings)
    score = F.col("score") if model is None else calibrated(F.col("score"), model)
    return kept.select(F.col("query_id").alias("rule_id"), "document_id", F.col("id").alias("chunk_id"), score.alias("vector_score"))


def rule_links(rules: DataFrame, least: float = DEFAULTS.link_threshold, model: str | None = None, settings=DEFAULTS) -> DataFrame:
    """(left_rule_id, right_rule_id, vector_score): each rule links to its nearest, at most five of twelve candidates; a pair keeps its best score."""
    both = rules.select(F.col("rule_id").alias("id"), "embedding")
    hits = dense_topk_join(both.withColumnRenamed("id", "query_id"), both, settings.rule_candidates + 1).where("query_id <> id")
    score = F.col("score") if model is None else calibrated(F.col("score"), model)
    per = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("_c", F.row_number().over(per)).where(F.col("_c") <= settings.rule_candidates)
    hits = hits.withColumn("s", score).where(F.col("s") >= least).withColumn("_r", F.row_number().over(per)).where(F.col("_r") <= settings.max_links_per_rule)
    return max_per_pair(hits.select("query_id", "id", "s"), "query_id", "id", "s").toDF("left_rule_id", "right_rule_id", "vector_score")


def max_per_pair(rows: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """(low, high, score): the best score of each undirected pair; order is that of the ids as text."""
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    low = F.when(x < y, F.col(a)).otherwise(F.col(b))
    high = F.when(x < y, F.col(b)).otherwise(F.col(a))
    return rows.where(x != y).groupBy(low.alias("low"), high.alias("high")).agg(F.max(score).alias(score))


def dedupe_bindings(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """One row per key: the best score, then the least id."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def refresh_bindings(current: DataFrame, found: DataFrame, document_id: str, settings=DEFAULTS) -> DataFrame:
    """Bindings after one document changed: its old ones go, the newly found ones come, 20 per rule stay."""
    rows = current.where(F.col("document_id") != document_id).unionByName(found.where(F.col("document_id") == document_id))
    order = Window.partitionBy("rule_id").orderBy(F.col("vector_score").desc(), "document_id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= settings.max_bindings).drop("_r")


def reachable_documents(links: DataFrame, bound: DataFrame) -> DataFrame:
    """(rule_id, documents): distinct documents bound to a rule or to a rule one link away."""
    both = links.select(F.col("left_rule_id").alias("rule_id"), F.col("right_rule_id").alias("via"))
    both = both.unionByName(both.select(F.col("via").alias("rule_id"), F.col("rule_id").alias("via")))
    own = bound.select("rule_id", F.col("rule_id").alias("via")).distinct()
    ways = both.unionByName(own).distinct()
    return ways.join(bound.select(F.col("rule_id").alias("via"), "document_id"), "via").groupBy("rule_id").agg(F.count_distinct("document_id").alias("documents"))


def rule_paths(roots: DataFrame, links: DataFrame, bound: DataFrame, most: int = DEFAULTS.max_paths) -> DataFrame:
    """(path_id, root_rule, linked_rule, score, document_ids): a root rule's own documents, and those of rules one link away.

    roots(rule_id, score). A direct path has the root's score; one over a link the mean of root and link. Without
    documents there is no path; the best `most` stay.
    """
    docs = bound.groupBy("rule_id").agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"))
    direct = roots.join(docs, "rule_id").select(F.col("rule_id").alias("root_rule"), F.lit(None).cast(roots.schema["rule_id"].dataType).alias("linked_rule"), "score", "document_ids")
    edge = links.select(F.col("left_rule_id").alias("a"), F.col("right_rule_id").alias("b"), "vector_score").where("a <> b")
    both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b"), "vector_score"))
    hop = roots.withColumnRenamed("rule_id", "a").join(both, "a").join(docs.withColumnRenamed("rule_id", "b"), "b")
    hop = hop.select(F.col("a").alias("root_rule"), F.col("b").alias("linked_rule"), ((F.col("score") + F.col("vector_score")) / 2).alias("score"), "document_ids")
    every = direct.unionByName(hop).withColumn("path_id", F.concat_ws(">", F.col("root_rule").cast("string"), F.col("linked_rule").cast("string")))
    return every.orderBy(F.col("score").desc(), "path_id").limit(most)
