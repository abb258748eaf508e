"""Files of any known type as blocks: text types go through windows over lines, the others through their readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.sources.detect import parser_version, source_type
from folioforge.sources.html import html_blocks
from folioforge.sources.markdown import block_id, document_titles, markdown_blocks
from folioforge.sources.office import office_blocks

_COLUMNS = {
    "document_id": "string", "block_index": "int", "block_id": "string", "kind": "string", "text": "string", "heading_path": "array<string>", "page": "int",
    "sheet": "string", "cell_range": "string", "image_index": "int", "start_offset": "int", "end_offset": "int",
}


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(document_id, name, mime_type, size_bytes, content) of all files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select(F.col("path").alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(None).cast("string").alias("mime_type"), F.col("length").alias("size_bytes"), "content")


def typed(files: DataFrame) -> DataFrame:
    """files with source_type, parser_version and content_hash."""
    rows = files.withColumn("source_type", source_type(F.col("name"), F.coalesce("mime_type", F.lit(""))))
    return rows.withColumn("parser_version", parser_version(F.col("source_type"))).withColumn("content_hash", F.sha2("content", 256))


def _shaped(blocks: DataFrame) -> DataFrame:
    if "block_id" not in blocks.columns:
        blocks = blocks.withColumn("block_id", block_id(F.col("block_index")))
    return blocks.select(*[(F.col(c) if c in blocks.columns else F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items()])


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, documents) of files as `read_files` gives them.

    documents(document_id, name, source_type, parser_version, content_hash, size_bytes, title, error): error says
    why a file has no blocks. Each type reads only its own files; a text that is no UTF-8 keeps replacement signs.
    """
    rows = typed(files)
    text = rows.where(F.col("source_type").isin("markdown", "text", "html")).withColumn("source", F.decode("content", "UTF-8"))
    plain = markdown_blocks(text.where("source_type <> 'html'"))
    pages = html_blocks(text.where("source_type = 'html'"), "document_id", "source")
    office = office_blocks(rows.where(F.col("source_type").isin("pdf", "docx", "xlsx")))
    blocks = reduce(DataFrame.unionByName, [_shaped(plain), _shaped(pages), _shaped(office.where("error IS NULL"))])
    named = document_titles(blocks, rows.select("document_id", "name"))
    failed = office.where("error IS NOT NULL").select("document_id", "error")
    docs = rows.select("document_id", "name", "source_type", "parser_version", "content_hash", "size_bytes").join(named, "document_id", "left").join(failed, "document_id", "left")
    return blocks, docs.withColumn("error", F.coalesce("error", F.when(F.col("source_type").isNull(), F.lit("unknown type"))))
