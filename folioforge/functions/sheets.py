"""Spreadsheet addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_number(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def column_letters(number: Column) -> Column:
    """1 -> A, 27 -> AA; up to five letters."""
    start = F.struct(number.cast("long").alias("n"), F.lit("").alias("s"))
    step = lambda a, _: F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).alias("n"), F.concat(F.char((a["n"] - 1) % 26 + 65), a["s"]).alias("s"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(5)), start, step, lambda a: a["s"])


def _short_number(letters: Column) -> Column:
    """The number of a column of one to three letters."""
    at = lambda i: F.ascii(F.substring(letters, i, 1)) - 64
    n = F.length(letters)
    return F.when(n == 1, at(1)).when(n == 2, at(1) * 26 + at(2)).when(n == 3, (at(1) * 26 + at(2)) * 26 + at(3))


def parse_range(a1: Column) -> Column:
    """struct(c1, r1, c2, r2) of A1 or A1:B2, with dollars allowed and corners in any order; null otherwise."""
    plain = F.upper(F.replace(F.trim(a1), F.lit("$"), F.lit("")))
    parts = F.regexp_extract_all(plain, F.lit("[A-Z]+|[0-9]+"), 0)

    def corners(p: Column) -> Column:
        c1, r1 = _short_number(F.get(p, 0)), F.get(p, 1).try_cast("int")
        c2, r2 = F.coalesce(_short_number(F.get(p, 2)), c1), F.coalesce(F.get(p, 3).try_cast("int"), r1)
        return F.struct(F.least(c1, c2).alias("c1"), F.least(r1, r2).alias("r1"), F.greatest(c1, c2).alias("c2"), F.greatest(r1, r2).alias("r2"))

    # The parts are bound once, as the variable of a lambda.
    return F.when(plain.rlike("^[A-Z]{1,3}[0-9]+(?::[A-Z]{1,3}[0-9]+)?$"), F.get(F.transform(F.array(parts), corners), 0))


def ranges_overlap(a: Column, b: Column) -> Column:
    return (a["c1"] <= b["c2"]) & (b["c1"] <= a["c2"]) & (a["r1"] <= b["r2"]) & (b["r1"] <= a["r2"])
