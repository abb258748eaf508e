"""License scans: MinHash bands over overlapping text windows retrieve templates; exact containment verifies.

Words are lower-cased and freed of punctuation; shingles are hashes of five words in order. A window is a series
of shingles, its MinHash value under a function the least of the shingles' hashes by that function (exclusive or
with a constant: two hashes are ordered by the highest bit in which they differ, so each constant orders them
anew). Equal band values of a text's window and a template's window retrieve the template for the text.

* Templates of LONG shingles or more, whole licenses: text windows of WIDE shingles, one at every STEP, against the
  template's windows at every offset. A text that holds CONTAINMENT of the template has a window with as large a
  share of a template's window, a similarity of 2/3 at least; WIDE_BANDS bands of two rows miss one such window
  with a probability of (1 - 4/9) ** WIDE_BANDS, 3 %, and longer templates have more of them.
* Shorter templates: text windows of two shingles against the template's runs of one and two. A text that holds a
  shingle of it has a window with a similarity of 1/2 at least, which BANDS bands of one row miss with
  probability 2 ** -BANDS, 1e-6.
* Templates of three and four words are one shingle of their own length, which is its own band value.

The first scan keeps the rows and templates that bands brought together, nothing else. The second one reads the
texts of these rows again (found by a bitmap of hashed keys, then by a join) and takes the exact share of the
template's distinct shingles that the whole text holds, which must reach CONTAINMENT.

Templates are a parameter, such as a folder of license texts; MAX_TEMPLATE_WORDS bounds them and so what is
broadcast. Texts are shuffled only where a template was retrieved. A row is known by its doc_id and the hash of
its text. Nulls: a null text has no words and no match; null doc_ids are told apart by their texts. Templates of
fewer than three words are refused. Repeated rows are reported each; empty tables give empty results; extra
columns do no harm.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, materialise, slots_for, with_bit

SHINGLE, CONTAINMENT = 5, 0.8
#: Bands of windows of two shingles.
BANDS = 20
#: Shingles from which on a template is long; width and distance of its text windows; their bands of two rows.
LONG, WIDE, STEP, WIDE_BANDS = 40, 16, 12, 6
MAX_TEMPLATE_WORDS = 100_000
#: Words of the shortest template.
LEAST = 3

#: Usual wordings of short license notices.
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software"
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation"
    ),
}
#: Characters that count as blanks between words.
PUNCTUATION = "\t\n\x0b\f\r.,;:!?()[]{}<>\"'`*#_/\\|+=~^&%$@-"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(f"[{re.escape(PUNCTUATION)} ]", text.lower()) if w]


def words_column(text: Column) -> Column:
    clean = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " " * len(PUNCTUATION))
    return F.array_remove(F.split(clean, " "), "")


def read_templates(folder: str) -> dict[str, str]:
    """Templates from a folder of license texts: the name of a file without its ending -> its text."""
    return {p.stem if p.suffix == ".txt" else p.name: p.read_text(encoding="utf-8", errors="replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


def _long(value: int) -> str:
    """A literal of SQL, the least one too."""
    return f"{value}L" if value > -(2**63) else f"({value + 1}L - 1L)"


def _mask(name: str) -> str:
    """The constant of a function, as a literal."""
    return _long(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big", signed=True))


def _shingles_sql(words: str, n: int = SHINGLE) -> str:
    parts = ", ".join(f"{words}[i + {k}]" for k in range(n))
    return f"CASE WHEN size({words}) >= {n} THEN transform(sequence(0, size({words}) - {n}), i -> xxhash64({parts})) ELSE array() END"


def _pair_keys() -> str:
    """SQL of the band values of the window (s0, s1), each marked with its band; null without shingles."""
    return "array(" + ", ".join(f"least(s0 ^ {_mask(f'band {b}')}, s1 ^ {_mask(f'band {b}')}) ^ {_mask(f'mark {b}')}" for b in range(BANDS)) + ")"


def _wide_keys(window: str) -> str:
    """SQL of the band values of a window that is an array."""
    least = lambda k: f"array_min(transform(v, s -> s ^ m.f{k}))"
    masks = "array(" + ", ".join(f"struct({_mask(f'wide {b} 0')} AS f0, {_mask(f'wide {b} 1')} AS f1)" for b in range(WIDE_BANDS)) + ")"
    return f"transform(array({window}), v -> transform({masks}, m -> xxhash64({least(0)}, {least(1)}, m.f0)))[0]"


def template_shingles(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, h): the shingles of each template in order, by its kind of shingle."""
    split = {name: words_of(text) for name, text in templates.items()}
    if not split:
        raise ValueError("no templates")
    if short := [n for n, w in split.items() if len(w) < LEAST]:
        raise ValueError(f"templates of fewer than {LEAST} words: {short}")
    if sum(map(len, split.values())) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words in all")
    if any(";" in n or "|" in n for n in split):
        raise ValueError("names of templates must contain neither ; nor |")
    listing = ";".join(f"{name}|{' '.join(words)}" for name, words in split.items())
    one = spark.range(1).select(F.explode(F.split(F.lit(listing), ";")).alias("e")).select(F.split("e", "[|]", 2).alias("e"))
    one = one.select(F.col("e")[0].alias("license"), F.split(F.col("e")[1], " ").alias("_w"))
    own = " ".join(f"WHEN size(_w) = {n} THEN {_shingles_sql('_w', n)}" for n in range(LEAST, SHINGLE))
    # Written, or the optimizer repeats the splitting inside lambdas and filters.
    return materialise(one.select("license", F.size("_w").alias("words"), F.expr(f"CASE {own} ELSE {_shingles_sql('_w')} END").alias("h")), "license-shingles")


def band_index(listed: DataFrame) -> DataFrame:
    """(key, license): the band values of all windows of the templates. At most 2 * BANDS or WIDE_BANDS a shingle."""
    tiny = listed.where(F.col("words") < SHINGLE).select(F.explode("h").alias("key"), "license")
    small = listed.where((F.col("words") >= SHINGLE) & (F.size("h") < LONG))
    runs = F.expr("flatten(transform(h, (s, i) -> array(struct(s AS s0, cast(NULL AS long) AS s1), struct(s AS s0, get(h, i + 1) AS s1))))")
    pairs = small.select("license", F.explode(runs).alias("w")).select("license", "w.*").select(F.explode(F.expr(_pair_keys())).alias("key"), "license")
    windows = F.expr(f"transform(sequence(0, size(h) - {WIDE}), i -> slice(h, i + 1, {WIDE}))")
    wide = listed.where((F.col("words") >= SHINGLE) & (F.size("h") >= LONG)).select("license", F.explode(windows).alias("v"))
    wide = wide.select(F.explode(F.expr(_wide_keys("v"))).alias("key"), "license")
    return tiny.unionByName(pairs).unionByName(wide).distinct()


def retrieved(docs: DataFrame, listed: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(doc_id, k, license): rows and templates with a band value in common; k is the hash of the text."""
    sizes = [len(words_of(t)) for t in templates.values()]
    more = []
    if any(n - SHINGLE + 1 >= LONG for n in sizes):
        more.append(f"CASE WHEN i % {STEP} = 0 AND i < size(_h) THEN {_wide_keys(f'slice(_h, i + 1, {WIDE})')} ELSE array() END")
    # At the end of a text fewer words are hashed, which no template's value is made of.
    tiny = [f"xxhash64({', '.join(f'get(_w, i + {j + k})' for k in range(n))})" for n in sorted({n for n in sizes if n < SHINGLE}) for j in (0, 1)]
    if tiny:
        more.append(f"array({', '.join(tiny)})")
    extra = f"concat({', '.join(more)})" if more else "cast(array() AS array<bigint>)"
    window = f"struct(get(_h, i) AS s0, get(_h, i + 1) AS s1, {extra} AS x)"
    rows = docs.select("doc_id", F.xxhash64("text").alias("k"), words_column(F.col("text")).alias("_w")).withColumn("_h", F.expr(_shingles_sql("_w")))
    # The outer forms: for inner ones the optimizer infers a filter that repeats the hashing inside the lambda.
    rows = rows.select("doc_id", "k", F.explode_outer(F.expr(f"transform(sequence(0, greatest(size(_w) - 1, 0), 2), i -> {window})")).alias("w"))
    rows = rows.select("doc_id", "k", "w.*").select("doc_id", "k", F.explode_outer(F.expr(f"concat({_pair_keys()}, x)")).alias("key"))
    return rows.join(F.broadcast(band_index(listed)), "key").select("doc_id", "k", "license").distinct()


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, k, license, containment): the templates that a row (doc_id and hash of its text) holds."""
    templates = templates if templates is not None else TEMPLATES
    listed = template_shingles(docs.sparkSession, templates)
    candidates = materialise(retrieved(docs, listed, templates), "licenses-retrieved")
    slots = slots_for(candidates.count())
    held = materialise(bitmap(candidates.select(F.pmod("k", F.lit(slots)).alias("slot"))), "licenses-bitmap")
    rows = docs.select("doc_id", F.xxhash64("text").alias("k"), "text")
    rows = with_bit(rows, F.pmod("k", F.lit(slots)), held, "_hit").where("_hit").select(F.col("doc_id").alias("r_id"), F.col("k").alias("r_k"), "text")
    rows = rows.join(candidates, (F.col("r_k") == F.col("k")) & F.col("r_id").eqNullSafe(F.col("doc_id")))
    rows = rows.join(F.broadcast(listed), "license")  # bounded by MAX_TEMPLATE_WORDS
    rows = rows.select("doc_id", "k", "license", "words", "h", words_column(F.col("text")).alias("_w"))
    own = " ".join(f"WHEN words = {n} THEN {_shingles_sql('_w', n)}" for n in range(LEAST, SHINGLE))
    share = f"size(array_intersect(CASE {own} ELSE {_shingles_sql('_w')} END, h)) / size(array_distinct(h))"
    # Repeated rows have equal shares. A filter on an aggregate stays behind it; else it would repeat the hashing inside the lambda.
    return rows.groupBy("doc_id", "k", "license").agg(F.max(F.expr(share)).alias("containment")).where(F.col("containment") >= CONTAINMENT)


def report(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_licenses, licenses (names in order, joined by commas)."""
    found = scan(docs, templates).groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("license")), ",").alias("names"))
    ids = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_k"))
    rows = ids.join(found, (F.col("_k") == F.col("k")) & F.col("_id").eqNullSafe(F.col("doc_id")), "left")
    return rows.select(F.col("_id").alias("doc_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("names", F.lit("")).alias("licenses"))
