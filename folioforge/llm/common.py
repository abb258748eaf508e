"""Helpers that the corpus operators share: table access, hashing splits and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus operators: blank and the five ASCII controls from tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
#: One word, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that Spark hands to a Python worker at once, where the session has Spark's own number of 10,000.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches of texts are some megabytes, not tens of them, in the JVM and in its workers. A number that the user has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; a file or a folder of part files."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a temporary one, but on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later jobs neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what `materialise` wrote, once nothing reads it any more, and let shuffle files go that nobody refers to."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    for df in frames[:1]:
        df.sparkSession._jvm.System.gc()


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:  # one pass each over bytes, which takes half the time of `translate`
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def fold_of(doc_id: Column, folds: int) -> Column:
    """The remainder that deals rows out to train and held-out sides: crc32 of the id as text (null: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


_BITS = 32768
#: Slots of a bitmap for each key that it holds, and the most it may have: 32 MiB.
SLOTS_PER_KEY, MOST_SLOTS = 16, 1 << 28


def slots_for(keys: int) -> int:
    slots = _BITS
    while slots < min(keys * SLOTS_PER_KEY, MOST_SLOTS):
        slots *= 2
    return slots


def bitmap(slots: DataFrame) -> DataFrame:
    """(row, bits) of a table of slots."""
    return slots.groupBy(F.floor(F.col("slot") / _BITS).cast("int").alias("row")).agg(F.expr(f"bitmap_construct_agg(slot % {_BITS})").alias("bits"))


def with_bit(rows: DataFrame, slot: Column, held: DataFrame, out: str) -> DataFrame:
    """`rows` with a boolean column: is the slot's bit set in the bitmap? Bitmaps are broadcast, their callers bound them."""
    held = F.broadcast(held.select(F.col("row").alias("_row"), F.col("bits").alias("_bits")))
    rows = rows.withColumn("_slot", slot)
    joined = rows.join(held, F.floor(F.col("_slot") / _BITS).cast("int") == F.col("_row"), "left")
    byte = f"cast(conv(hex(substring(_bits, cast((_slot % {_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.col("_bits").isNotNull() & (F.expr(f"shiftright({byte}, cast(_slot % 8 as int)) & 1") == 1)
    return joined.withColumn(out, bit).drop("_bits", "_row", "_slot")
