"""Word-bounded overlapping chunks with exact source spans: Spark makes one row per segment, a small helper cuts its words."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import DEFAULTS
from folioforge.functions.ids import chunk_id
from folioforge.functions.text import SENTENCE_END, SPACE

_LOCATION = ("page", "sheet", "cell_range", "image_index", "preview_block", "start_offset", "end_offset")
_TYPES = {"page": "int", "sheet": "string", "cell_range": "string", "image_index": "int", "preview_block": "int", "start_offset": "int", "end_offset": "int"}


def check_options(target: int, most: int, overlap: int) -> None:
    if target < 1 or most < 1:
        raise ValueError("target_words and max_words must be at least 1")
    if target > most:
        raise ValueError("target_words must not exceed max_words")
    if not 0 <= overlap < target:
        raise ValueError("overlap_words must be at least 0 and below target_words")


def segment_key() -> Column:
    """What must not change within a chunk: the place (page, else sheet and range, else picture) and the heading path."""
    place = (
        F.when(F.col("page").isNotNull(), F.concat(F.lit("page:"), F.col("page").cast("string")))
        .when(F.coalesce(F.col("sheet"), F.lit("")) != "", F.concat(F.lit("sheet:"), F.col("sheet"), F.lit(":range:"), F.coalesce("cell_range", F.lit(""))))
        .when(F.col("image_index").isNotNull(), F.concat(F.lit("image:"), F.col("image_index").cast("string")))
        .otherwise("document")
    )
    return F.concat(place, F.lit(":heading:"), F.to_json(F.coalesce("heading_path", F.array().cast("array<string>")), {"ignoreNullFields": "false"}))


def with_locations(blocks: DataFrame) -> DataFrame:
    """The blocks with every location column, null where missing."""
    for c in _LOCATION:
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, F.lit(None).cast(_TYPES[c]))
    return blocks if "heading_path" in blocks.columns else blocks.withColumn("heading_path", F.array().cast("array<string>"))


def segment_islands(blocks: DataFrame, key: str = "document_id") -> DataFrame:
    """The blocks with `segment`: numbers of runs of neighbours with equal keys. A block without words still ends a run."""
    order = Window.partitionBy(key).orderBy("block_index")
    rows = with_locations(blocks).withColumn("_key", segment_key())
    new = ~F.col("_key").eqNullSafe(F.lag("_key").over(order))
    return rows.withColumn("segment", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_key")


#: Words and ends of sentences as `functions.text` has them.
_WORD = re.compile("[^" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SPACE) + "]+")
_END = re.compile(SENTENCE_END[:-1] + r"\Z")
_SPAN = ("i", "start_offset", "end_offset", "start_word", "end_word")
_CUT = f"array<struct<text:string,word_count:int,spans:array<struct<{','.join(f'{c}:int' for c in _SPAN)}>>>>"


def windows(n: int, ends: list[int], target: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of n words; ends are the numbers of words after which one may end, in order."""
    least, s, out = max(1, target * 3 // 4), 0, []
    while s < n:
        e = n
        if s + most < n:
            at = bisect_left(ends, s + target)
            before = bisect_right(ends, s + target) - 1
            if at < len(ends) and ends[at] < s + most:
                e = ends[at]
            elif before >= 0 and ends[before] >= s + least:
                e = ends[before]
            else:
                e = s + most
        out.append((s, e))
        s = e - overlap if e < n and e - overlap > s else e
    return out


def _cutter(target: int, most: int, overlap: int):
    """UDF from the texts of a segment's blocks to its chunks, each with what it covers of each block."""

    def cut(segments: pa.Array) -> pa.Array:
        texts, counts, per_segment, per_chunk = [], [], [0], [0]
        spans: list[tuple[int, ...]] = []
        for blocks in segments.to_pylist():
            ws: list[str] = []
            ends, upto = [], []  # where a chunk may end; words before the end of each block
            for text in blocks or []:
                own = _WORD.findall(text)
                ends += [len(ws) + j for j, w in enumerate(own, 1) if j == len(own) or _END.search(w)]
                ws += own
                upto.append(len(ws))
            chars = [0, *accumulate(len(w) + 1 for w in ws)]
            for s, e in windows(len(ws), ends, target, most, overlap):
                for i in range(bisect_right(upto, s), bisect_left(upto, e) + 1):
                    w0 = upto[i - 1] if i else 0
                    a, z = max(s, w0), min(e, upto[i])
                    spans.append((i, chars[a] - chars[w0], chars[z] - chars[w0] - 1, a - w0, z - w0))
                texts.append(" ".join(ws[s:e]))
                counts.append(e - s)
                per_chunk.append(len(spans))
            per_segment.append(len(texts))
        flat = np.array(spans, dtype=np.int32).reshape(-1, len(_SPAN))
        covered = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], list(_SPAN))
        cuts = [pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(pa.array(per_chunk, pa.int32()), covered)]
        return pa.ListArray.from_arrays(pa.array(per_segment, pa.int32()), pa.StructArray.from_arrays(cuts, ["text", "word_count", "spans"]))

    cut.__annotations__ = {"segments": pa.Array, "return": pa.Array}
    return F.arrow_udf(cut, _CUT)


def segments(blocks: DataFrame, key: str = "document_id") -> DataFrame:
    """One row per segment that has words: its blocks `bs` in order."""
    rows = segment_islands(blocks, key).where(F.col("text").rlike(f"[^{SPACE}]"))
    block = F.struct("block_index", "block_id", "heading_path", *_LOCATION, "text")
    return rows.groupBy(key, "segment").agg(F.array_sort(F.collect_list(block)).alias("bs"))


def chunks(blocks: DataFrame, key: str = "document_id", target: int = DEFAULTS.target_words, most: int = DEFAULTS.max_words, overlap: int = DEFAULTS.overlap_words) -> DataFrame:
    """(key, chunk_id, ordinal, text, word_count, heading_path, block_start, block_end, focus_block, location, source_spans).

    From a start the chunk ends after the first sentence or block end at `target` words or later but before
    `most`, else after the last one between three quarters of `target` and `target`, else at `most`; the next
    one starts `overlap` words before that end. Chunks never cross segments. Offsets count characters of the
    block's text. A segment is one row; its chunks are cut out of its words before they become rows of their own.
    """
    check_options(target, most, overlap)
    rows = segments(blocks, key).withColumn("cuts", _cutter(target, most, overlap)(F.col("bs.text")))
    rows = rows.select(key, "segment", F.posexplode(F.transform("cuts", _chunk)).alias("k", "c"))
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("segment", "k")) - 1
    rows = rows.select(key, ordinal.alias("ordinal"), "c.*")
    first, last = F.element_at("source_spans", 1), F.element_at("source_spans", -1)
    one, two = F.col("one"), F.col("two")
    place = [F.coalesce(one[c], two[c]).alias(c) for c in _LOCATION[:5]]
    return rows.select(
        key, "ordinal", chunk_id(F.col(key), F.col("ordinal")).alias("chunk_id"), "text", "word_count",
        F.when(F.size(one["heading_path"]) > 0, one["heading_path"]).otherwise(two["heading_path"]).alias("heading_path"),
        first["block_index"].alias("block_start"), last["block_index"].alias("block_end"),
        F.coalesce(one["preview_block"], first["block_index"]).alias("focus_block"),
        F.struct(
            *place,
            (F.coalesce(one["start_offset"], F.lit(0)) + first["start_offset"]).alias("start_offset"),
            (F.coalesce(two["start_offset"], F.lit(0)) + last["end_offset"]).alias("end_offset"),
        ).alias("location"),
        "source_spans",
    )


def _chunk(cut: Column) -> Column:
    """A chunk from its cut: text, first and last block, and the words and characters that it covers of each block that it touches."""

    def span(x: Column) -> Column:
        block = F.get("bs", x["i"])
        return F.struct(
            block["block_id"].alias("block_id"), block["block_index"].alias("block_index"), *[x[c].alias(c) for c in _SPAN[1:]],
            *[block[c].alias(c) for c in ("page", "sheet", "cell_range", "image_index")],
        )

    own = lambda i: F.struct(*[F.get("bs", i)[c].alias(c) for c in ("heading_path", *_LOCATION)])
    first, last = F.element_at(cut["spans"], 1)["i"], F.element_at(cut["spans"], -1)["i"]
    return F.struct(cut["text"].alias("text"), cut["word_count"].alias("word_count"), own(first).alias("one"), own(last).alias("two"), F.transform(cut["spans"], span).alias("source_spans"))


def batches(rows: DataFrame, key: str, order: str, text: str = "text", most: int = DEFAULTS.batch_chunks, chars: int = DEFAULTS.batch_chars) -> DataFrame:
    """(key, order, batch): greedy batches of at most `most` rows and `chars` characters; a longer row has one of its own."""
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length(text).alias("l")))).alias("xs"))
    start = F.expr("struct(0 AS batch, 0 AS n, 0L AS chars, cast(array() AS array<int>) AS out)")
    fits = lambda a, x: (a["n"] == 0) | ((a["n"] < most) & (a["chars"] + x["l"] <= chars))

    def step(a: Column, x: Column) -> Column:
        same = F.struct(a["batch"].alias("batch"), (a["n"] + 1).alias("n"), (a["chars"] + x["l"]).alias("chars"), F.array_append(a["out"], a["batch"]).alias("out"))
        new = F.struct((a["batch"] + 1).alias("batch"), F.lit(1).alias("n"), x["l"].cast("long").alias("chars"), F.array_append(a["out"], a["batch"] + 1).alias("out"))
        return F.when(fits(a, x), same).otherwise(new)

    dealt = got.withColumn("batch", F.aggregate("xs", start, step, lambda a: a["out"]))
    return dealt.select(key, F.explode_outer(F.arrays_zip("xs", "batch")).alias("z")).select(key, F.col("z.xs.o").alias(order), F.col("z.batch").alias("batch"))
