"""Carriers: the test tables seen as repository tables, and helpers that Spark and SQL share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where there is one."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def documents_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk: title of its first 40 characters, its language as heading."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit(0).alias("ordinal"), F.substring("text", 1, 40).alias("title"), F.array("lang").alias("heading_path"), "text")


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one block."""
    from folioforge.functions.text import SPACE, collapse

    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(f"[^{SPACE}]"))
    return d.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("block_index"), F.lit("block_000000").alias("block_id"), collapse(F.col("text")).alias("text"))


def line_blocks(spark: SparkSession, sf_dir: str, lines_per_page: int | None = None) -> DataFrame:
    """Each line of a document as a block, optionally on pages of so many lines."""
    from folioforge.sources.markdown import number_blocks

    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "text"), F.lit("paragraph").alias("kind"))
    rows = number_blocks(rows, "document_id", "n").drop("kind")
    return rows.withColumn("page", F.floor(F.col("block_index") / lines_per_page).cast("int")) if lines_per_page else rows


#: SQL of the words of a text, of its text with single blanks, and of the lines that are blocks.
SPACE_SQL = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
COLLAPSED = f"trim(regexp_replace(coalesce(text, ''), '{SPACE_SQL}', ' ', 'g'))"
LINES_SQL = f"""
raw AS (SELECT doc_id AS document_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
numbered AS (SELECT document_id, i, trim(regexp_replace(ls[i], '{SPACE_SQL}', ' ', 'g')) AS text FROM (SELECT document_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
blocks AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS block_index, text FROM numbered WHERE text <> '')"""


def bounds_sql(target: int, most: int, overlap: int) -> str:
    """CTEs after words(document_id, w, n, bp): bounds(document_id, k, s, e) of the chunks of one segment per document."""
    least = max(1, target * 3 // 4)
    end = f"""CASE WHEN s + {most} >= n THEN n ELSE coalesce(
        list_min(list_filter(bp, lambda b: b >= s + {target} AND b < s + {most})),
        list_max(list_filter(bp, lambda b: b <= s + {target} AND b >= s + {least})), s + {most}) END"""
    return f"""
walk AS (
  SELECT document_id, 0 AS k, 0 AS s, {end.replace("s +", "0 +")} AS e, n, bp FROM words WHERE n > 0
  UNION ALL
  SELECT document_id, k + 1, s, {end} AS e, n, bp FROM (
    SELECT document_id, k, CASE WHEN e - {overlap} > s THEN e - {overlap} ELSE e END AS s, n, bp FROM walk WHERE e < n)
),
bounds AS (SELECT document_id, k, s, e FROM walk)"""


#: Ends of sentences as RE2 has them.
END_SQL = r"""[.!?。！？][\]})"''’”]*$"""
