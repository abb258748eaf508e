"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: slot (offset + k * skip) mod size
for k = 0, 1, ... Shards take turns; each claims its first preferred slot that is still free, until the table
is full. A document's id is hashed to a slot, and the slot names its shard. The table depends only on the
shard names and its size (size entries, a proven bound), so it is broadcast and placement costs one probe.
Shares differ by one slot at most, and removing a shard moves few documents of the others.

Nulls: a null doc_id is placed as the empty text is. Repeated rows go to the same shard, empty tables give
empty results, and extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters: 64 shards over 8191 slots, a prime about 128 times the shards.
SHARDS, TABLE_SIZE = 64, 8191


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """slot -> index of its shard. `size` must be prime and no smaller than the number of shards."""
    if not shards or size < len(shards) or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime of at least the number of shards, which must be 1 or more")
    offset = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    table, tried, taken = [-1] * size, [0] * len(shards), 0
    while taken < size:
        for i in range(len(shards)):
            slot = (offset[i] + tried[i] * skip[i]) % size
            while table[slot] >= 0:
                tried[i] += 1
                slot = (offset[i] + tried[i] * skip[i]) % size
            table[slot] = i
            tried[i] += 1
            taken += 1
            if taken == size:
                break
    return table


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def slot_of(doc_id: Column, size: int) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """(slot, shard) rows made from one literal, without RDDs."""
    one = spark.range(1).select(F.split(F.lit(",".join(map(str, table))), ",").alias("t"))
    return one.select(F.posexplode("t").alias("slot", "s")).select(F.col("slot").cast("long").alias("_slot"), F.col("s").cast("int").alias("_shard"))


def assign_shards(docs: DataFrame, shards: list[str] | None = None, size: int = TABLE_SIZE, out: str = "shard", key: str = "doc_id") -> DataFrame:
    """The rows with a column `out`, the index of the shard. A column of that name is replaced."""
    table = lookup_table(shards if shards is not None else shard_names(), size)
    # Rows travel as one struct, so no column of theirs can meet an inner name.
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"), slot_of(docs[f"`{key}`"], size).alias("_slot"))
    placed = rows.join(F.broadcast(table_frame(docs.sparkSession, table)), "_slot")
    columns = [F.col("_shard").alias(out) if c == out else F.col(f"_doc.`{c}`") for c in docs.columns]
    return placed.select(*columns, *([] if out in docs.columns else [F.col("_shard").alias(out)]))
