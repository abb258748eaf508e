"""A corpus pipeline: toxic documents go, copies go, near copies go, sources are mixed to weight, texts become ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as
Parquet and read again as the next one's documents, after which the one before is deleted.

Nulls: a null text is an empty one, which is clean, a copy of other empty texts, near to none, and never taken by the
mix (it has no words); a null doc_id is a value like any other. Of repeated rows and of copies one row stays (most code
points, then smallest doc_id), of near copies the one with the least doc_id. A row that the mix takes twice is encoded
twice. Rows keep all their columns, whatever their names, up to the last stage, which returns doc_id, n_tokens and the
digests of its ids and decoded bytes. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import byte_bpe, exact_dedup, jaccard_join, mixing, toxicity
from folioforge.llm.common import materialise, release, table


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("toxicity", filter_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The classifier of the first stage has no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if hasattr(before, "stored_at"):
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
