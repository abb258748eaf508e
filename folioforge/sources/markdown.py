"""Markdown and plain text as blocks, with windows over lines: no Python code touches the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import SPACE, collapse, trimmed, without_extension

_HEADING = rf"^(#{{1,6}})[{SPACE}]+(.+?)[{SPACE}]*#*[{SPACE}]*$"
_FENCE = rf"^[{SPACE}]*```"
_LIST = rf"^[{SPACE}]*[-*+][{SPACE}]+"


def block_id(index: Column) -> Column:
    return F.concat(F.lit("block_"), F.lpad(index.cast("string"), 6, "0"))


def lines(sources: DataFrame, key: str = "document_id", text: str = "source") -> DataFrame:
    """(key, n, line, at, size): numbered lines with the offset of each; any line end becomes one character."""
    unified = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    rows = sources.select(key, F.length(text).alias("size"), F.posexplode_outer(F.split(unified, "\n", -1)).alias("n", "line")).where("line IS NOT NULL")
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))


def markdown_blocks(sources: DataFrame, key: str = "document_id", text: str = "source") -> DataFrame:
    """(key, block_index, block_id, kind, text, heading_path, start_offset, end_offset) of each source.

    A fence line toggles code, in which nothing is a heading and blank lines do not end a paragraph. A heading
    of level n cuts the path to n - 1 and stands at place n; skipped levels are null. A paragraph ends at a
    heading, a blank line or the end of the source, and is a list if it starts with a bullet.
    """
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    rows = lines(sources, key, text).withColumn("fence", F.col("line").rlike(_FENCE))
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)) % 2 == 1)
    free = ~F.col("fence") & ~F.col("inside")
    rows = rows.withColumn("level", F.when(free & F.col("line").rlike(_HEADING), F.length(F.regexp_extract("line", _HEADING, 1))))
    rows = rows.withColumn("title", F.when(F.col("level").isNotNull(), trimmed(F.regexp_extract("line", _HEADING, 2))))
    rows = rows.withColumn("blank", free & F.col("level").isNull() & (trimmed(F.col("line")) == ""))
    rows = rows.withColumn("break", F.col("level").isNotNull() | F.col("blank"))
    path = []
    for lv in range(1, 7):
        own = F.max(F.when(F.col("level") == lv, F.struct("n", "title"))).over(upto)
        cut = F.max(F.when(F.col("level") < lv, F.col("n"))).over(upto)
        path.append(F.when(own["n"] > F.coalesce(cut, F.lit(-1)), own["title"]))
    depth = F.last("level", ignorenulls=True).over(upto)
    rows = rows.select(
        key, "n", "line", "at", "size", "level", "title", "blank", "break",
        F.coalesce(F.slice(F.array(*path), F.lit(1), F.coalesce(depth, F.lit(0))), F.array().cast("array<string>")).alias("path"),
        F.sum(F.col("break").cast("int")).over(upto).alias("run"),
        F.min(F.when(F.col("break"), F.col("at"))).over(after).alias("next_break"),
    )
    heads = rows.where("level IS NOT NULL").select(
        key, "n", F.lit("heading").alias("kind"), F.col("title").alias("text"), F.col("path").alias("heading_path"),
        F.col("at").alias("start_offset"), (F.col("at") + F.length("line")).alias("end_offset"),
    )
    grouped = rows.where("NOT break").groupBy(key, "run").agg(
        F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"), F.first("path").alias("heading_path"),
        F.min("at").alias("start_offset"), F.max(F.coalesce("next_break", "size")).alias("end_offset"),
    )
    joined = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    kind = F.when(joined.rlike(_LIST), "list").otherwise("paragraph")
    paragraphs = grouped.select(key, "n", kind.alias("kind"), joined.alias("text"), "heading_path", "start_offset", "end_offset")
    return number_blocks(heads.unionByName(paragraphs), key, "n")


def number_blocks(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Collapse white space, drop empty blocks, number the rest from 0 in the order given."""
    rows = rows.where(F.col("text").rlike(f"[^{SPACE}]")).withColumn("text", collapse(F.col("text")))  # not a test of the result: that would collapse twice
    rows = rows.withColumn("block_index", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    rest = [c for c in rows.columns if c not in (key, order, "block_index", "kind", "text")]
    return rows.select(key, "block_index", block_id(F.col("block_index")).alias("block_id"), "kind", "text", *rest)


def document_titles(blocks: DataFrame, names: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, title): the first heading, else the file name without its last extension."""
    first = blocks.where("kind = 'heading'").groupBy(key).agg(F.min_by("text", "block_index").alias("heading"))
    return names.join(first, key, "left").select(key, F.coalesce("heading", without_extension(F.col("name"))).alias("title"))
