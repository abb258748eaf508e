"""Scores: calibration of raw cosines and its inverses, cosine itself, fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The model whose cosines lie between 0.85 and 1, that floor, and the width above it.
NARROW_MODEL, FLOOR, WIDTH = "intfloat/multilingual-e5-small", 0.85, 0.15


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def calibrated(score: Column, model: Column | str = NARROW_MODEL) -> Column:
    model = F.lit(model) if isinstance(model, str) else model
    return F.when(model == NARROW_MODEL, clamp((score - FLOOR) / WIDTH)).otherwise(clamp(score))


def raw_threshold(final: Column, model: str = NARROW_MODEL) -> Column:
    return F.lit(FLOOR) + WIDTH * clamp(final) if model == NARROW_MODEL else clamp(final)


def pair_floor(final: Column) -> Column:
    """The least pair score with which a link can reach the final threshold, full coverage granted."""
    return clamp((final - 0.2) / 0.8)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
