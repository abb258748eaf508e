"""Exact dedup by progressive refinement: length, then a prefix hash, then a full hash of the groups that survive.

Texts are equal when they are identical once white space is deleted. The first scan counts lengths; a length
that occurs once settles its row. The second hashes the first PREFIX code points of rows whose length survives
and counts (length, prefix hash) groups. The third hashes the full content of rows whose group survives. What
survives travels from scan to scan as bitmaps: one bit per length below LENGTHS (longer texts always go on), at
most 1 MiB; and by hash slots, 16 for each surviving group, at most 32 MiB. A
false hit costs one needless hash and nothing else, since only full hashes make groups.

Only numbers and hashes are shuffled, texts never; copies meet in an aggregate that combines on the map side,
so a group of a third of all rows is one row per task. The rows of the third scan are written once and read
twice, by the aggregate and by the join with it.

Nulls: a null text is an empty one; a null doc_id is a value like any other and sorts before the rest.
Repeated rows are copies; of rows that tie in everything all are marked kept by `duplicate_groups`, and one is
kept by `keep_one`. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, materialise, release, slots_for, squeezed, with_bit

#: Code points of the normalised text that the second level hashes.
PREFIX = 64
#: Texts of this length or more go on to the second level without a look at their length.
LENGTHS = 1 << 23


def _normalised(docs: DataFrame, *carry: Column | str) -> DataFrame:
    """What `carry` names, _size (code points of the text), _norm and _n (its code points)."""
    size = F.length(F.coalesce(F.col("text"), F.lit(""))).alias("_size")
    rows = docs.select(*carry, size, squeezed(F.col("text")).alias("_norm"))
    return rows.withColumn("_n", F.length("_norm").cast("long"))


def surviving_lengths(docs: DataFrame) -> DataFrame:
    """The bitmap of lengths below LENGTHS that two documents or more have: at most LENGTHS / 32768 rows of 4 KiB."""
    lengths = _normalised(docs).groupBy("_n").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) & (F.col("_n") < LENGTHS))
    return bitmap(lengths.select(F.col("_n").alias("slot")))


def _prefixed(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """`rows` with _key: the hash of length and prefix where the length survives, else null."""
    rows = with_bit(rows, F.when(F.col("_n") < LENGTHS, F.col("_n")), lengths, "_same_length")
    key = F.xxhash64("_n", F.substring("_norm", 1, PREFIX))
    return rows.withColumn("_key", F.when(F.col("_same_length") | (F.col("_n") >= LENGTHS), key)).drop("_same_length")


def surviving_groups(docs: DataFrame, lengths: DataFrame) -> tuple[DataFrame, int]:
    """The bitmap of (length, prefix hash) groups of two documents or more, and its number of slots."""
    keys = _prefixed(_normalised(docs), lengths).where(F.col("_key").isNotNull()).groupBy("_key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    stored = materialise(keys.select("_key"), "prefix-groups")
    slots = slots_for(stored.count())
    held = materialise(bitmap(stored.select(F.pmod("_key", F.lit(slots)).alias("slot"))), "prefix-bitmap")
    release(stored)
    return held, slots


def _hashed(docs: DataFrame, *carry: Column | str) -> DataFrame:
    """What `carry` names, _id, _size, _norm and _hit: does the row need its full hash?"""
    lengths = materialise(surviving_lengths(docs), "length-bitmap")
    groups, slots = surviving_groups(docs, lengths)
    rows = _prefixed(_normalised(docs, *carry, F.col("doc_id").alias("_id")), lengths)
    return with_bit(rows, F.pmod("_key", F.lit(slots)), groups, "_hit")


def duplicate_groups(docs: DataFrame, digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, full_hash (null where none was needed).

    Of equal texts the one with the most code points in the original stays, then the smallest doc_id; rows
    that repeat the doc_id that stays are all marked kept. `digests` adds text_sha256 for every row.
    """
    sha = F.sha2("_norm", 256)
    columns = [F.when(F.col("_hit"), sha).alias("full_hash")] if not digests else [sha.alias("text_sha256"), "_hit"]
    rows = materialise(_hashed(docs).select("_id", "_size", *columns), "full-hashes")
    if digests:
        rows = rows.select("_id", "_size", "text_sha256", F.when(F.col("_hit"), F.col("text_sha256")).alias("full_hash"))
    # A row that needs no full hash is alone; the others are told apart by the hash.
    more = ["text_sha256"] if digests else []
    alone = rows.where("full_hash IS NULL").select(
        F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash", *more
    )
    keyed = rows.where("full_hash IS NOT NULL")
    best = keyed.groupBy("full_hash").agg(F.min(F.struct((-F.col("_size")).alias("neg"), F.col("_id").alias("id"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    grouped = keyed.join(best, "full_hash").select(
        F.col("_id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        "group_size",
        ((-F.col("best.neg") == F.col("_size")) & F.col("best.id").eqNullSafe(F.col("_id"))).alias("kept"),
        "full_hash",
        *more,
    )
    return alone.unionByName(grouped)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group of equal texts, every column kept.

    Rows that are alone pass straight through; of the others one whole row per hash is chosen by an aggregate
    that combines before the shuffle.
    """
    names = docs.columns
    rows = _hashed(docs, F.struct(*[docs[f"`{c}`"] for c in names]).alias("_doc"))
    alone = rows.where(~F.col("_hit")).select("_doc.*")
    groups = rows.where("_hit").groupBy(F.sha2("_norm", 256).alias("_sha"))
    chosen = groups.agg(F.min_by("_doc", F.struct((-F.col("_size")).alias("neg"), F.col("_id").alias("id"))).alias("_doc"))
    return alone.unionByName(chosen.select("_doc.*"))
