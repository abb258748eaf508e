"""Deterministic ids and canonical pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_uuid(text: Column) -> Column:
    """A UUID-shaped prefix of the SHA-256 of a text, with version nibble 5 and the variant bits of RFC 4122."""
    h = F.sha2(text, 256)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def node_id(owner: Column, kind: Column, entity: Column) -> Column:
    return stable_uuid(F.concat_ws(":", F.lit("node"), owner, kind, entity))


def link_id(owner: Column, left: Column, right: Column) -> Column:
    return stable_uuid(F.concat_ws(":", F.lit("link"), owner, F.least(left, right), F.greatest(left, right)))


def chunk_id(version: Column, ordinal: Column) -> Column:
    return F.concat(version.cast("string"), F.lit(":"), F.lpad(ordinal.cast("string"), 6, "0"))


def is_pair(a: Column, b: Column) -> Column:
    """Whether two ids make an undirected pair: both there, not blank, not the same."""
    return F.coalesce((F.trim(a) != "") & (F.trim(b) != "") & (a != b), F.lit(False))
