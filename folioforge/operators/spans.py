"""Highlights: merging spans of a text, blocks to mark, overlap of cell ranges, rows of a sheet to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.sheets import parse_range, ranges_overlap
from folioforge.session import stored


def merge_spans(spans: Column, size: Column) -> Column:
    """Spans (start, end) cut to the text, in order, with overlaps joined."""
    cut = F.transform(spans, lambda s: F.struct(F.greatest(F.lit(0), F.least(s["start"], size)).alias("start"), F.greatest(F.lit(0), F.least(s["end"], size)).alias("end")))
    good = F.array_sort(F.filter(cut, lambda s: s["end"] > s["start"]))
    none = F.filter(good, lambda _: F.lit(False))

    def step(got: Column, s: Column) -> Column:
        last = F.try_element_at(got, F.lit(-1))
        joined = F.concat(F.slice(got, F.lit(1), F.greatest(F.lit(0), F.size(got) - 1)), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(got) > 0) & (s["start"] <= last["end"]), joined).otherwise(F.array_append(got, s))

    return F.aggregate(good, none, step)


def slices(rows: DataFrame, key: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """(key, n, piece, marked): the text cut at its merged spans."""
    merged = rows.withColumn("_m", merge_spans(F.col(spans), F.length(text)))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.length(text)), F.flatten(F.transform("_m", lambda s: F.array(s["start"], s["end"]))))))
    got = merged.withColumn("_c", cuts).select(key, text, "_m", "_c", F.posexplode_outer(F.slice("_c", F.lit(1), F.greatest(F.lit(0), F.size("_c") - 1))).alias("n", "a")).where("a IS NOT NULL")
    end = F.element_at("_c", F.col("n") + 2)
    return got.select(key, "n", F.substring(text, F.col("a") + 1, end - F.col("a")).alias("piece"), F.exists("_m", lambda s: (s["start"] <= F.col("a")) & (F.col("a") < s["end"])).alias("marked"))


def marked_blocks(spans: Column, start: Column, end: Column) -> Column:
    """Indexes of the blocks to mark: those of the spans, else all from start to end."""
    own = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["block_index"])))
    return F.when(F.size(own) > 0, own).otherwise(F.sequence(start, F.greatest(start, end)))


def overlapping_cells(shown: DataFrame, marks: DataFrame) -> DataFrame:
    """(sheet, shown_range, mark_range) of cell ranges that share a cell, sheet by sheet; a row for each pair of rows."""
    a = _parsed(shown)
    b = a if marks is shown else _parsed(marks)
    a = a.select("sheet", "_bucket", F.col("cell_range").alias("shown_range"), F.struct(*_CORNERS).alias("a"))
    b = b.select("sheet", "_bucket", F.col("cell_range").alias("mark_range"), F.struct(*_CORNERS).alias("b"))
    # Two ranges meet in every bucket that both have; they count in the first of these.
    once = F.col("_bucket") == F.greatest(F.floor(F.col("a.r1") / ROWS), F.floor(F.col("b.r1") / ROWS))
    return a.join(b, ["sheet", "_bucket"]).where(once & ranges_overlap(F.col("a"), F.col("b"))).select("sheet", "shown_range", "mark_range")


#: Rows of a sheet that share a bucket.
ROWS = 256
_CORNERS = ("c1", "r1", "c2", "r2")


def _parsed(rows: DataFrame) -> DataFrame:
    """(sheet, cell_range, c1, r1, c2, r2, _bucket): each range is parsed once and stored as numbers, then dealt to its buckets of rows."""
    parsed = rows.select("sheet", "cell_range").withColumn("_r", parse_range(F.col("cell_range")))
    parsed = stored(parsed.select("sheet", "cell_range", *[F.col(f"_r.{c}").alias(c) for c in _CORNERS]), "ranges").where("c1 IS NOT NULL")
    return parsed.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("r1") / ROWS), F.floor(F.col("r2") / ROWS))))


def sheet_regions(cells: DataFrame) -> DataFrame:
    """cells(document_id, sheet, row, column, text) -> (document_id, sheet, region, first_row, last_row, first_column, last_column).

    Neighbouring rows with a cell form a region.
    """
    rows = cells.where(F.trim("text") != "").groupBy("document_id", "sheet", "row").agg(F.min("column").alias("lo"), F.max("column").alias("hi"))
    order = Window.partitionBy("document_id", "sheet").orderBy("row")
    rows = rows.withColumn("_new", (F.col("row") != F.coalesce(F.lag("row").over(order), F.lit(-1)) + 1).cast("int"))
    rows = rows.withColumn("region", F.sum("_new").over(order) - 1)
    return rows.groupBy("document_id", "sheet", "region").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("lo").alias("first_column"), F.max("hi").alias("last_column"))


def append_insights(blocks: DataFrame, insights: DataFrame, key: str = "document_id") -> DataFrame:
    """Blocks with those made from pictures after them: insights(key, n, text, heading_path, image_index)."""
    size = blocks.groupBy(key).agg((F.max("block_index") + 1).alias("_n"))
    order = Window.partitionBy(key).orderBy("n")
    more = insights.where(F.trim("text") != "").join(size, key, "left")
    more = more.withColumn("block_index", (F.coalesce("_n", F.lit(0)) + F.row_number().over(order) - 1).cast("int")).withColumn("kind", F.lit("image")).drop("_n", "n")
    return blocks.unionByName(more, allowMissingColumns=True)
