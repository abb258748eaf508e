"""Tables that are replaced as snapshots: upsert, delete by filter, atomic replacement, pointers to what is current."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Last write wins: rows of `incoming` replace those of equal keys (nulls equal nulls); of several incoming one stays.

    That is the one with the greatest `order`, and of these, or without an order, the greatest in column order.
    What is not touched is not sorted: the current table is only probed with the incoming keys.
    """
    names = [c for c in incoming.columns if c not in keys]
    first = [order] if order is not None else []
    best = F.max(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*first, *names])])).alias("_p")
    base = len(first)
    incoming = incoming.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_p._{base + i}").alias(c) for i, c in enumerate(names)]) if names else incoming.distinct()
    return _without(current, incoming.select(*keys), keys).unionByName(incoming, allowMissingColumns=True)


def _without(current: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys are not among `gone`; nulls equal nulls."""
    gone = gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys]
    return current.join(gone, same, "left_anti")


def delete_where(current: DataFrame, owner_id, **equal) -> DataFrame:
    """The rows that stay after those of an owner with all the given values went. Without a value nothing may go."""
    if not equal:
        raise ValueError("a deletion needs a document, version, rule or node")
    test = F.col("owner_id") == owner_id
    for name, value in equal.items():
        test = test & F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else test & (F.col(name) == value)
    return current.where(~F.coalesce(test, F.lit(False)))


def replace_group(current: DataFrame, incoming: DataFrame, keys: Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """All rows of each group are replaced by the incoming ones; `groups` names groups that may become empty."""
    gone = incoming.select(*keys) if groups is None else incoming.select(*keys).unionByName(groups.select(*keys))
    return _without(current, gone, keys).unionByName(incoming, allowMissingColumns=True)


def check_collection(table: DataFrame, size: int, vector: str = "embedding", sparse: bool = True) -> None:
    """Raise where vectors have another size, or where the sparse part is missing; never repaired silently."""
    if sparse and "sparse_text" not in table.columns:
        raise ValueError("the collection has no sparse part")
    if not table.where(F.coalesce(F.size(vector) != size, F.lit(True))).isEmpty():
        raise ValueError(f"the collection holds vectors of another size than {size}")


class Snapshots:
    """Versions of a table under one folder, each written whole; numbered pointer files name them, the highest counts.

    A pointer appears by one rename and is never replaced, so readers see the old version until then, there is always
    a current one, and a failed write changes nothing. Of two writers that take the same number one fails.
    """

    def __init__(self, spark: SparkSession, path: str, partition: Sequence[str] = ("owner_id",)) -> None:
        self.spark, self.path, self.partition = spark, path.rstrip("/"), tuple(partition)
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def _latest(self) -> int:
        return max((int(n[8:]) for n in self._names() if n.startswith("CURRENT-") and n[8:].isdigit()), default=0)

    def current(self) -> str | None:
        number = self._latest()
        return self.spark.read.text(f"{self.path}/CURRENT-{number}").first()[0] if number else None

    def read(self) -> DataFrame:
        name = self.current()
        if name is None:
            raise FileNotFoundError(f"no version under {self.path}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def replace(self, rows: DataFrame) -> str:
        name = f"v-{uuid.uuid4().hex}"
        rows.write.partitionBy(*[c for c in self.partition if c in rows.columns]).parquet(f"{self.path}/{name}")
        number, fresh = self._latest() + 1, self._p(f"NEW-{name}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(name.encode()))
        out.close()
        pointer = self._p(f"CURRENT-{number}")
        if self._fs.exists(pointer) or not self._fs.rename(fresh, pointer):
            self._fs.delete(fresh, True)
            raise RuntimeError(f"another writer has published version {number} of {self.path}")
        return name

    def drop_old(self) -> int:
        """Delete all but the current version and pointer; the number of versions that went."""
        keep, gone = {self.current(), f"CURRENT-{self._latest()}"}, 0
        for name in self._names():
            if name not in keep and name.startswith(("v-", "CURRENT-", "NEW-")):
                self._fs.delete(self._p(name), True)
                gone += name.startswith("v-")
        return gone


def store_points(chunks: DataFrame, owner: Column | str = "owner_id") -> DataFrame:
    """What is stored for a chunk: a deterministic id, the text for the sparse part and the one for the embedder."""
    from folioforge.functions.ids import stable_uuid
    from folioforge.functions.text import passage_text, text_for_index

    text = text_for_index(F.col("title"), F.col("heading_path"), F.col("text"))
    return chunks.withColumn("point_id", stable_uuid(F.concat_ws(":", owner, F.col("chunk_id")))).withColumn("sparse_text", text).withColumn("dense_text", passage_text(text))
