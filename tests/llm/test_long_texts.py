"""Texts above a mebibyte, read whole by the operators that take whole texts."""

import random

import pytest

from folioforge.llm import exact_dedup, license_scan, mixing, quality_rules, source_divergence, toxicity

from . import brute
from .conftest import documents


@pytest.fixture(scope="module")
def long_rows():
    r = random.Random(7)
    body = " ".join(f"w{r.randint(0, 5000)}" for _ in range(220_000))
    assert len(body) > 1 << 20
    rows = [(1, body, "en", "a"), (2, body.replace(" ", "\n", 900), "en", "a"), (3, body + " end", "en", "b"), (4, "x" * 1_200_000, "en", "b"), (5, "short text", "en", "a")]
    return rows + [(6, body[:600_000] + "\nAll rights reserved.\n" + body[600_000:], "en", "c"), (7, "line of text\n" * 100_000, "en", "c"), (8, "é# " * 500_000, "de", None)]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return documents(spark, long_rows).repartition(4).cache()


def test_copies(long_docs, long_rows):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.duplicate_groups(long_docs, digests=True).collect()}
    assert got == {r[0]: x for r, x in zip(long_rows, brute.copies(long_rows), strict=True)}


def test_counts(spark, long_docs, long_rows):
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(long_docs, labels).collect()}
    assert got == {r[0]: brute.counts(r[1]) for r in long_rows}


def test_notice_in_the_middle(long_docs):
    found = {r.doc_id: r.licenses for r in license_scan.report(long_docs).collect()}
    assert found[6] == "all-rights-reserved" and all(not x for k, x in found.items() if k != 6)


def test_mix(long_docs, long_rows):
    got = {r.doc_id: r.size for r in mixing.mix(long_docs).collect()}
    assert got == {r[0]: len(brute.WORD.findall(r[1])) for r in long_rows}


def test_the_end_of_a_long_text_counts(spark):
    calm = " ".join(["quiet", "garden", "walk"] * 90_000)
    rows = [(k, f"you are awful {k}" if k % 2 else f"a quiet walk {k}", "en", "s") for k in range(200)] + [(900, calm, "en", "s"), (901, calm + " awful" * 30, "en", "s")]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(200)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.classify(documents(spark, rows), labels).collect()}
    assert scores[901] > scores[900]


def test_terms(long_docs):
    used = {r.item for r in source_divergence.audit(long_docs, 1).where("part = 'term'").collect()}
    assert "é" not in used or "end" in used  # the last word of the third text is a term of its source
    assert "end" in used
