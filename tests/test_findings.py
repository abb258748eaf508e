"""What a review found: limits that the SQL of a query does not have, growth of what is shuffled."""

import duckdb
import numpy as np

from pyspark.sql import functions as F

from folioforge.functions.text import trimmed
from folioforge.operators import chunking, nearest, postings, search
from folioforge.plans import graph_plans, text_plans
from folioforge.plans.common import SQL


def test_a_link_beyond_the_thousand_best_is_found(spark, sf, monkeypatch):
    """with 1500 better links elsewhere the links of the root still lead to its documents."""
    far = spark.range(1500).selectExpr("id + 100000 AS link_id", "id + 5000 AS left_node_id", "id + 9000 AS right_node_id", "0.99D AS semantic_score")
    real = graph_plans._nation_links
    expected = {tuple(r) for r in graph_plans.unified_search(spark, sf).collect()}
    monkeypatch.setattr(graph_plans, "_nation_links", lambda *a: real(*a).unionByName(far))
    assert {tuple(r) for r in graph_plans.unified_search(spark, sf).collect()} == expected
    assert any(r[0] == "expanded" for r in expected)
    assert search.top_links(far, None).count() == 1500 and search.top_links(far).count() == 1000


def test_statements_of_any_number_and_length_are_validated(spark, tmp_path):
    """250 turns of one conversation, some above 2000 characters."""
    rows = spark.range(250).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "concat('turn ', id % 230, repeat(' x', cast(id % 7 * 300 AS int))) AS text")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = sorted(con.sql(SQL["rule_validation"]).fetchall())
    assert sorted(tuple(r) for r in text_plans.rule_validation(spark, str(tmp_path)).collect()) == expected
    assert sum(r[2] == "" for r in expected) > 100


def test_a_query_is_ranked_from_few_rows(spark, monkeypatch):
    """F3 to F9, F11: rows to be ranked and copies of vectors do not grow with the number of blocks; results are exact in any cut."""
    r = np.random.default_rng(8)
    m = r.normal(size=(1500, 6))
    m[700:760] = m[3]
    rows = spark.createDataFrame([(i, i // 10, v.tolist()) for i, v in enumerate(m)], "id long, grp long, vector array<double>")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    s[np.arange(1500)[:, None] // 10 == np.arange(1500)[None, :] // 10] = -2
    order = np.argsort(-s, axis=1, kind="stable")[:, :7]
    expected = {(i, int(j), k + 1) for i in range(1500) for k, j in enumerate(order[i])}
    monkeypatch.setattr(nearest, "BLOCK", 16)
    for least_queries in (512, 3):
        monkeypatch.setattr(nearest, "LEAST_QUERIES", least_queries)
        got = nearest.nearest(rows, rows, 7, other_group=True)
        assert {(x.query_id, x.id, x.rank) for x in got.collect()} == expected


def test_probes_of_most_lists_become_a_whole_search(spark):
    """F3 to F9, F11: vectors without structure are searched exactly, not sent to most lists."""
    r = np.random.default_rng(9)
    m = r.normal(size=(800, 24))
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(m)], "id long, grp long, vector array<float>")
    exact, got = ({(x.query_id, x.id) for x in nearest.nearest(rows, rows, 10, list_size=n).collect()} for n in (None, 20))
    assert got == exact and len(exact) == 8000


def test_windows_are_those_of_the_definition():
    """F12 to F14: the cuts by bisection against the definition."""
    r = np.random.default_rng(5)
    for n, target, most, overlap in [(0, 4, 6, 1), (1, 1, 1, 0), (90, 8, 8, 7), (300, 8, 16, 0), (500, 20, 30, 2), (500, 12, 13, 11)]:
        ends = sorted({int(x) for x in r.integers(1, max(2, n), n // 6)} | {n})
        got, s = [], 0
        while s < n:
            later = [b for b in ends if s + target <= b < s + most]
            before = [b for b in ends if s + max(1, target * 3 // 4) <= b <= s + target]
            e = n if s + most >= n else later[0] if later else before[-1] if before else s + most
            got.append((s, e))
            s = e - overlap if e < n and e - overlap > s else e
        assert chunking.windows(n, ends, target, most, overlap) == got


def test_ends_are_trimmed_character_by_character(spark):
    """every white space of ECMAScript, and no other: a blank before a final next-line character stays."""
    spaces = "\t\n\x0b\f\r \xa0       　﻿"
    texts = [spaces + "a b" + spaces[::-1], "a \x85", "", spaces, "​ x", None, "x\r\n y \r"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", trimmed(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["a b", "a \x85", "", "", "​ x", None, "x\r\n y"]


def test_terms_are_counted_inside_the_row(spark):
    """counting the terms of chunks takes one exchange, which brings rows of one key together."""
    chunks = spark.createDataFrame([("a", "x y x"), ("b", ""), ("c", None), ("a", "b"), ("d", "Q q w")], "chunk_id string, text string")
    counted = postings._counted(chunks, 3, "chunk_id", "text")
    got = {r.key: (r.len, [tuple(t) for t in r.terms]) for r in counted.collect()}
    assert got == {"a": (3, [("x", 2), ("y", 1)]), "b": (0, []), "c": (0, []), "d": (3, [("q", 2), ("w", 1)])}
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # the final plan and the initial one
