"""Sparse logistic regression by follow-the-regularised-leader updates, over 32-bit hashed features."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))


class FTRL:
    """FTRL-proximal with per-coordinate rates; weights below the L1 threshold are exactly 0."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        """`at` holds every coordinate once."""
        n = self.n[at]
        squares = gradient * gradient
        self.z[at] += gradient - (np.sqrt(n + squares) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + squares


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most `limit` labelled rows outside the held-out fold.

    The rows with the smallest hashes of their ids are taken, so reruns agree. `limit` is the proven bound of
    what is broadcast (ids and labels only) and of what the trainer reads. A doc_id that is labelled twice
    keeps its largest label; of repeated documents one text stays.
    """
    from .common import fold_of

    wanted = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(fold_of(F.col("doc_id"), folds) != left_out)
    wanted = wanted.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    wanted = wanted.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))


def learn(
    sample: DataFrame,
    features: Callable[[], Callable[[str], tuple[np.ndarray, np.ndarray | None]]],
    fit: Callable[[list[tuple[bytes, bytes | None, int]]], pa.RecordBatch | None],
    schema: str,
    most: int,
) -> DataFrame:
    """`fit` over the features of the sampled rows (doc_id, text, label), in one task of its own.

    features() gives a function from a text to two arrays (the second may be None). They are made where the texts
    are, so only features meet in the task; it takes rows by the hashes of their ids, each that fits beside those before within `most` bytes.
    """
    kind = sample.schema["doc_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features()
        for batch in batches:
            got = [of(text.as_py() or "") for text in batch.column(1)]
            parts = [pa.array([None if g[k] is None else g[k].tobytes() for g in got], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *parts], names=["doc_id", "label", "x", "y"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                size = len(row[2]) + len(row[3] or b"")
                if held + size <= most:  # a row that does not fit leaves its place to later ones
                    rows.append(row)
                    held += size
        rows.sort(key=lambda r: r[0])
        learnt = fit([(x, y, label) for _, label, x, y in rows])
        if learnt is not None:
            yield learnt

    rows = sample.select("doc_id", "text", "label").mapInArrow(extract, f"doc_id {kind}, label int, x binary, y binary")
    return rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(17), "doc_id"), "doc_id").mapInArrow(train, schema)
