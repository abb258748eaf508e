"""Sessions and table access."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_STORED: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioforge")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a temporary one, but on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends there, and no later round computes it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.setdefault(spark, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete what `stored` has written in this session, once no result that reads it is needed any more; the number of tables."""
    paths = _STORED.pop(spark, [])
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def numbered(rows: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """`rows` with their places in the order, from 0. Sorted ranges are counted and numbered, so no task holds all rows."""
    at = F.monotonically_increasing_id()
    ranges = stored(rows.orderBy(*order).withColumn("_range", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND((1 << 33) - 1)), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return ranges.join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")
