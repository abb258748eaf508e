"""Rows that share a doc_id, or have none: each is a row of its own."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import jaccard_join, linear, mixing

from . import brute
from .conftest import documents


def texts(seed=5):
    r = random.Random(seed)
    return lambda n: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 30)) for _ in range(n))


def shared_rows():
    text = texts()
    a, u, b = text(60), text(60), text(60)
    rows = [(3, a), (7, a + " tail"), (7, u), (None, b), (None, b + " x"), (None, u + " y"), (None, None), (None, ""), (9, "one"), (9, "one")]
    for k in range(6):
        base = text(70)
        rows += [(20 + k % 2, base), (None if k % 2 else 20, base + " end"), (20, base + " other end"), (20, base)]
    return [(*r, "en", "s") for r in rows]


def test_join_of_rows_that_share_an_id(spark):
    rows = shared_rows()
    got = sorted(map(str, map(tuple, jaccard_join.near_duplicates(documents(spark, rows).repartition(3)).collect())))
    assert got == sorted(str((r[0], *x)) for r, x in zip(rows, brute.near(rows), strict=True))


def test_join_keeps_one_row_of_each_class(spark):
    rows = shared_rows()
    sets, parent = [brute.shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                parent[find(i)] = find(j)
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(documents(spark, rows).repartition(3)).collect()]
    place = {r[:2]: find(i) for i, r in enumerate(rows)}
    groups = collections.Counter(place[k] for k in kept if brute.shingles(k[1]))
    assert set(groups.values()) == {1} and set(groups) == {find(i) for i, x in enumerate(sets) if x}
    assert sum(1 for k in kept if not brute.shingles(k[1])) == sum(1 for x in sets if not x)
    least = collections.defaultdict(list)
    for r in rows:
        least[place[r[:2]]].append((r[0] is not None, r[0] or 0))
    assert all((i is not None, i or 0) == min(least[place[i, t]]) for i, t in kept)


def same_ids(kind):
    words = texts(8)
    text = [words(10) for _ in range(1000)]
    if kind == "null":
        return [(None, t, "en", "s") for t in text]
    if kind == "one":
        return [(1, t, "en", "s") for t in text]
    if kind == "five":
        return [(k % 5, t, "en", "s") for k, t in enumerate(text)]
    return [(1, text[0], "en", "s")] * 600 + [(k, t, "en", "s") for k, t in enumerate(text[:300])] + [(None, text[1], "en", "s")] * 100


@pytest.mark.parametrize("kind", ["null", "one", "five", "equal"])
def test_mix_of_rows_that_share_an_id(spark, kind):
    rows = same_ids(kind)
    docs = documents(spark, rows).repartition(7)
    got = mixing.mix(docs).collect()
    assert len(got) == 1000 and {r.target for r in got} == {15_000.0}
    assert abs(sum(r.taken for r in got) - 15_000) <= 10 and {r.taken for r in got} == {10, 20}
    mixed = collections.Counter((r.doc_id, r.text) for r in mixing.mixed_documents(docs).collect())
    assert sum(mixed.values()) * 10 == sum(r.taken for r in got)
    given = collections.Counter(r[:2] for r in rows)
    assert all(given[k] <= n <= 2 * given[k] for k, n in mixed.items()) and mixed.keys() == given.keys()
    by_id = collections.Counter()
    for r in got:
        by_id[r.doc_id] += r.taken
    expected = collections.Counter()
    for (doc_id, _), n in mixed.items():
        expected[doc_id] += 10 * n
    assert by_id == expected
    assert sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, got))


def test_copies_are_numbered_without_gaps(spark):
    rows = spark.createDataFrame([(1, "a", None, k << 33 | j) for k in range(4) for j in range(5)] + [(None, "b", "s", 7), (1, "c", "s", 8)], "doc_id long, code string, source string, at long")
    got = mixing.numbered_copies(rows).collect()
    assert sorted(r.nth for r in got if r.code == "a") == list(range(20)) and {r.nth for r in got if r.code != "a"} == {0}


def test_a_row_that_does_not_fit_leaves_the_others(spark):
    sample = spark.createDataFrame([(k, "x" * (1000 if k == 3 else 10), k % 2) for k in range(20)], "doc_id long, text string, label int")

    def features():
        return lambda text: (np.zeros(len(text), dtype=np.int8), None)

    def fit(rows):
        return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    assert linear.learn(sample, features, fit, "n long", 500).first().n == 19
    assert linear.learn(sample, features, fit, "n long", 55).first().n == 5
