"""From evidence to an answer: context packing, citation checks, merging of sources, presentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import DEFAULTS


def first_of_each(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """One row per key, the one that comes first."""
    order = Window.partitionBy(*keys).orderBy(position)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def pack_context(sources: DataFrame, key: str = "request_id", most: int = DEFAULTS.context_sources, chars: int = DEFAULTS.context_chars) -> DataFrame:
    """sources(key, position, text, ...) that fit: blanks skipped, at most ten, 24 000 characters, the last one cut."""
    upto = Window.partitionBy(key).orderBy("position")
    rows = sources.where(F.trim("text") != "").withColumn("_n", F.row_number().over(upto)).where(F.col("_n") <= most)
    rows = rows.withColumn("_left", F.lit(chars) - (F.sum(F.length("text")).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("text")))
    rows = rows.where("_left > 0").withColumn("text", F.col("text").substr(F.lit(1), F.least(F.col("_left"), F.length("text")).cast("int")))
    return rows.drop("_n", "_left")


def verify_citations(answers: DataFrame, sources: DataFrame, key: str = "request_id") -> DataFrame:
    """answers(key, answer, citation_chunk_ids, insufficient_evidence) with citations that exist, each once, in order.

    Without a valid citation, or without an answer, evidence counts as insufficient.
    """
    known = sources.groupBy(key).agg(F.collect_set("chunk_id").alias("_known"))  # at most ten a request
    rows = answers.join(known, key, "left")
    cited = F.array_distinct(F.filter(F.coalesce("citation_chunk_ids", F.array().cast("array<string>")), lambda c: F.array_contains(F.coalesce("_known", F.array().cast("array<string>")), c)))
    rows = rows.withColumn("citation_chunk_ids", cited)
    thin = F.coalesce("insufficient_evidence", F.lit(False)) | (F.size("citation_chunk_ids") == 0) | (F.coalesce(F.trim("answer"), F.lit("")) == "")
    return rows.withColumn("insufficient_evidence", thin).drop("_known")


def merge_sources(seeds: DataFrame, rules: DataFrame, expanded: DataFrame, cited: DataFrame, path_rules: DataFrame) -> DataFrame:
    """The sources an answer shows: direct hits, rules that are cited or on a cited path, expanded hits; each chunk once.

    All have chunk_id and position; cited(chunk_id); path_rules(chunk_id, path_chunk_id) ties a rule's chunk to the
    expanded chunks of its paths.
    """
    on_path = path_rules.join(cited.select(F.col("chunk_id").alias("path_chunk_id")), "path_chunk_id", "left_semi").select("chunk_id")
    wanted = cited.select("chunk_id").unionByName(on_path).distinct()
    parts = [seeds.withColumn("section", F.lit(0)), rules.join(wanted, "chunk_id", "left_semi").withColumn("section", F.lit(1)), expanded.withColumn("section", F.lit(2))]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    return first_of_each(every.withColumn("_p", F.struct("section", "position")), ["chunk_id"], "_p").drop("_p")


def present(answers: DataFrame) -> DataFrame:
    """answers(answer, insufficient_evidence, extractive, failed) with `mode` and `shown`."""
    mode = F.when(F.col("failed"), "failure").when(F.col("insufficient_evidence"), "extractive").otherwise("generated")
    shown = F.when(mode == "generated", F.col("answer")).when(mode == "failure", F.concat(F.lit("The answer could not be generated. "), F.col("extractive"))).otherwise(F.col("extractive"))
    return answers.withColumn("mode", mode).withColumn("shown", shown)
