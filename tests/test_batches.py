"""Batches in which several rows name one key, and writes that are committed together."""

import random

import pytest
from pyspark.sql.types import StructType

from folioforge.operators import folders, rules, search, writes
from folioforge.sources.commits import Repository
from folioforge.streaming import jobs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_keys_that_a_batch_repeats(spark):
    table = spark.createDataFrame([(1, True), (2, True), (3, False)], "k int, enabled boolean")
    out, refused = writes.set_enabled(table, spark.createDataFrame([(1, True), (1, False), (3, True), (9, True), (2, None)], "k int, enabled boolean"), "k")
    assert rows(out) == [(1, False), (2, True), (3, True)] and sorted(r.k for r in refused.collect()) == [2, 9]
    failing = spark.createDataFrame([("a", "failed", "2024-01-01", None), ("b", "ready", None, None)], "job_id string, status string, cleanup_started_at string, cleanup_error string")
    got = writes.fail_cleanups(failing, spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "v")], "job_id string, message string"))
    assert {r.job_id: r.cleanup_error for r in got.collect()} == {"a": "w", "b": None} and got.count() == 2
    pending = spark.createDataFrame([("d", "pending", 0, None), ("e", "pending", 1, None), ("f", "pending", 2, None)], "document_id string, status string, attempts int, last_error string")
    got = writes.settle_deletions(pending, spark.createDataFrame([("d", None), ("d", "bad"), ("d", "awful"), ("e", None), ("e", None)], "document_id string, error string"))
    assert sorted(tuple(r[c] for c in ("document_id", "status", "attempts", "last_error")) for r in got.collect()) == [("d", "failed", 1, "bad"), ("f", "pending", 2, None)]
    got = folders.move(spark.createDataFrame([("x", "p"), ("y", "p")], "id string, folder_id string"), spark.createDataFrame([("x", "q"), ("x", None), ("y", "r"), ("y", "q")], "id string, target string"), "folder_id")
    assert rows(got) == [("x", None), ("y", "q")]


def test_renames_of_one_batch(spark):
    now = spark.createDataFrame([("a", None, "A"), ("b", None, "B"), ("c", None, "C"), ("d", "a", "D")], "id string, parent_id string, name string")
    asked = spark.createDataFrame([("a", "x"), ("b", " X "), ("d", "x"), ("c", "A"), ("z", "q"), ("b", "y"), ("d", "w")], "id string, name string")
    got = {(r.id, r.name): r.reason for r in writes.rename_folders(now, asked).collect()}
    assert got == {("a", "x"): None, ("b", " X "): "duplicate", ("d", "x"): "duplicate", ("d", "w"): None, ("c", "A"): "duplicate", ("z", "q"): "missing", ("b", "y"): "duplicate"}
    given = [(i, n) for (i, n), reason in got.items() if reason is None]
    assert len({i for i, _ in given}) == len(given)
    parent = {"a": None, "b": None, "c": None, "d": "a"}
    assert len({(parent[i], n.strip().lower()) for i, n in given}) == len(given)


def test_the_machine_of_the_stream_is_that_of_the_batch(spark):
    r = random.Random(12)
    log = []
    for job in range(150):
        for seq in range(r.randint(1, 14)):
            kind = r.choice(["claim", "claim", "stage", "stage", "ready", "failure", "failure", "upload-failed", "reupload", "other"])
            error = r.choice([*jobs.JOB_STAGES, None]) if kind == "stage" else r.choice([None, "", "bad", "é" * 600])
            log.append((job, seq, kind, r.choice(["t1", "t1", "t2", None]), error, r.choice([True, False, None])))
    batch = {x.job_id: tuple(x)[1:] for x in jobs.replay(spark.createDataFrame(log, "job_id int, seq int, kind string, token string, error string, retryable boolean")).collect()}
    for job in range(150):
        s = dict(jobs.FIRST)
        for _, _, kind, token, error, retryable in (e for e in log if e[0] == job):
            s = jobs.advance(s, kind, token, error, bool(retryable))
        assert batch[job] == tuple(s.values()), job


def test_spans_of_any_form(spark):
    texts = ["Der Preis ist  heiß.", "café au lait", "café au lait", "a\nb c", None, "😀 smile here", "x\x1cy z"]
    phrases = ["Preis ist heiß", "café", "café", " b c ", "", None, "smile", "a b", "here\x1c", "﻿z", "y z"]
    given = [(k, t, p) for k, (t, p) in enumerate((t, p) for t in texts for p in phrases)]
    got = {r.k: (r.found, r.start_offset, r.end_offset) for r in rules.exact_spans(spark.createDataFrame(given, "k int, text string, phrase string").repartition(3)).collect()}
    assert got == {k: rules.find_span(t, p) or (None, None, None) for k, t, p in given}
    assert sum(v[0] is not None for v in got.values()) >= 10


def test_evidence_of_rules_is_in_their_order(spark):
    hits = spark.createDataFrame([("c2", 0.5), ("c1", 0.5)], "chunk_id string, score double")
    of = spark.createDataFrame([("c9", 0.7, 1), ("c3", 0.7, 2), ("c4", 0.9, 3)], "chunk_id string, score double, rule_id int")
    got = [r.chunk_id for r in search.answer_evidence(hits, of, hits.limit(0)).collect()]
    assert got == ["c1", "c2", "c4", "c9", "c3"]


VERSIONS, CHUNKS = "owner_id string, version_id string, status string, error_message string", "owner_id string, version_id string, chunk_id int"


def test_failed_versions_lose_their_chunks(spark, tmp_path):
    versions = spark.createDataFrame([("o", v, "parsing", None) for v in "abc"] + [("p", "a", "ready", None)], VERSIONS)
    chunks = spark.createDataFrame([(o, v, k) for o, v in (("o", "a"), ("o", "b"), ("o", "c"), ("p", "a")) for k in range(3)], CHUNKS)
    failures = spark.createDataFrame([("o", "a", "try again", False), ("o", "b", "later", False), ("o", "b", "x" * 600, True), ("o", "zz", "unknown", True)], "owner_id string, version_id string, message string, final boolean")
    want = [("o", "a", "parsing", "try again"), ("o", "b", "failed", "x" * 500), ("o", "c", "parsing", None), ("p", "a", "ready", None)]
    got, left = writes.fail_versions(versions, chunks, failures)
    assert rows(got) == want and {r[:2] for r in rows(left)} == {("o", "c"), ("p", "a")}
    home = Repository(spark, f"file://{tmp_path}/r")
    with home.begin() as t:
        t.create("document_versions", StructType.fromDDL(VERSIONS), ["owner_id", "version_id"], "owner_id")
        t.create("document_chunks", StructType.fromDDL(CHUNKS), ["owner_id", "version_id", "chunk_id"], "owner_id")
        t.rewrite("document_versions", versions)
        t.rewrite("document_chunks", chunks)
    now = writes.commit_failures(home, failures)
    assert rows(now.read("document_versions")) == want and rows(now.read("document_chunks")) == rows(left)


@pytest.fixture
def rule_home(spark, tmp_path):
    home = Repository(spark, f"file://{tmp_path}/r")
    schemas = {
        "rules": ("rule_id long, rule_document_id string, ordinal int, statement string, enabled boolean, embedding array<double>", ["rule_id"]),
        "bindings": ("rule_id long, document_id long, chunk_id long, vector_score double", ["rule_id", "document_id"]),
        "links": ("left_rule_id long, right_rule_id long, vector_score double", ["left_rule_id", "right_rule_id"]),
    }
    old = {"rules": [(7, "doc-a", 0, "old", True, [1.0, 0.0]), (8, "doc-c", 0, "kept", True, [0.0, 1.0])], "bindings": [(7, 100, 1, 0.5), (8, 100, 1, 0.9)], "links": [(7, 8, 0.5)]}
    with home.begin() as t:
        for name, (schema, keys) in schemas.items():
            t.create(name, StructType.fromDDL(schema), keys)
            t.rewrite(name, spark.createDataFrame(old[name], schema))
    return home


def test_rule_documents_are_committed_in_one(spark, rule_home):
    chunks = spark.createDataFrame([("doc-a", 0, 1, "Trips need approval.")], "document_id string, ordinal int, chunk_id long, text string")
    targets = spark.createDataFrame([(1, 100, [0.0, 1.0], "t")], "chunk_id long, document_id long, embedding array<double>, text string")
    provider = lambda batch: [{"source_chunk_id": "1", "statement": "Trips need approval", "evidence_quote": "Trips need approval.", "confidence": 0.9}]
    embed = lambda rows: rows.join(spark.createDataFrame([("Trips need approval", [0.1, 1.0])], "statement string, embedding array<double>"), "statement")
    before = rule_home.at()
    report = writes.commit_rule_documents(rule_home, chunks, targets, embed=embed, provider=provider)
    assert [(r.document_id, r.problem, r.rules) for r in report.collect()] == [("doc-a", None, 1)]
    now = rule_home.at()
    assert now.number == before.number + 1
    fresh = next(r.rule_id for r in now.read("rules").collect() if r.rule_document_id == "doc-a")
    assert {r.rule_id for r in now.read("rules").collect()} == {8, fresh} and fresh != 7
    assert {(r.rule_id, r.document_id) for r in now.read("bindings").collect()} == {(8, 100), (fresh, 100)}
    assert {frozenset(r[:2]) for r in now.read("links").collect()} == {frozenset((8, fresh))}
    assert rows(before.read("links")) == [(7, 8, 0.5)]

    def dies(_):
        raise RuntimeError("the model is away")

    with pytest.raises(Exception, match="away"):
        writes.commit_rule_documents(rule_home, chunks, targets, embed=dies, provider=provider)
    assert rule_home.at().number == now.number
