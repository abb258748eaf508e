"""Source types, upload metadata, names and paths as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import collapse, trimmed, without_extension

MAX_BYTES = 50 * 1024 * 1024
MAX_TOOL_BYTES = 10 * 1024 * 1024

#: Source types by file extension and by MIME type, and the MIME type stored for each.
BY_EXTENSION = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "txt": "text"}
CANONICAL_MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "markdown": "text/markdown",
    "html": "text/html",
    "text": "text/plain",
}
BY_MIME = {mime: kind for kind, mime in CANONICAL_MIME.items()}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def source_type(name: Column, mime: Column) -> Column:
    """By extension first, then by MIME type; null when neither is known."""
    bare = F.lower(trimmed(F.split_part(mime, F.lit(";"), F.lit(1))))
    return F.coalesce(F.try_element_at(_map(BY_EXTENSION), extension(name)), F.try_element_at(_map(BY_MIME), F.coalesce(bare, F.lit(""))))


def parser_version(kind: Column) -> Column:
    return F.concat(kind, F.lit("-blocks-1"))


def validate_uploads(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """files(name, mime_type, size_bytes, ...) with source_type, canonical mime_type, and reason (null: accepted)."""
    rows = files.withColumn("name", trimmed(F.col("name"))).withColumn("source_type", source_type(F.col("name"), F.col("mime_type")))
    reason = (
        F.when(F.length("name").isNull() | ~F.length("name").between(1, 1024), "name")
        .when(F.col("size_bytes").isNull() | ~F.col("size_bytes").between(1, limit), "size")
        .when(F.col("source_type").isNull(), "type")
    )
    return rows.withColumn("mime_type", F.try_element_at(_map(CANONICAL_MIME), F.coalesce("source_type", F.lit("")))).withColumn("reason", reason)


def rename_reason(old: Column, new: Column) -> Column:
    """Why a file may not get a new name; null when it may."""
    new = trimmed(new)
    return (
        F.when(F.length(new).isNull() | ~F.length(new).between(1, 1024), "length")
        .when(new.rlike(r"[/\\\x00-\x1F\x7F]"), "characters")
        .when(~(extension(old) == extension(new)), "extension")
        .when(trimmed(without_extension(new)) == "", "empty")
    )


def folder_name_reason(name: Column) -> Column:
    name = trimmed(name)
    return F.when(F.length(name).isNull() | ~F.length(name).between(1, 200), "length").when(name.contains("/"), "slash")


def owned_path(path: Column, owner: Column, document: Column, version: Column) -> Column:
    """Whether a storage path is owner/document/version-file of the ids given."""
    p = F.split(path, "/")
    return (F.size(p) == 4) & (F.get(p, F.lit(0)) == owner) & (F.get(p, F.lit(1)) == document) & (F.get(p, F.lit(2)) == version) & (F.length(F.get(p, F.lit(3))) > 0)


def manual_rule(content: Column) -> Column:
    """struct(content, title, filename, reason) of a rule typed by hand."""
    text = trimmed(F.replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    title = F.substring(trimmed(F.split_part(text, F.lit("\n"), F.lit(1))), 1, 60)
    stem = F.substring(collapse(F.regexp_replace(title, r'[/\\:*?"<>|\x00-\x1F]+', " ")), 1, 48)
    safe = F.when(trimmed(stem) == "", "rule").otherwise(trimmed(stem))
    reason = F.when(F.length(text).isNull() | ~F.length(text).between(1, 2000), "length")
    return F.struct(text.alias("content"), title.alias("title"), F.concat(safe, F.lit(".md")).alias("filename"), reason.alias("reason"))
