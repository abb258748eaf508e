import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import folders, models, retrieval, search, writes
from folioforge.operators.models import Fatal
from folioforge.sources import store


def test_deep_trees_are_whole(spark):
    n = 300
    tree = spark.createDataFrame([(k, k - 1 if k else None, f"f{k}", 0) for k in range(n)], "id long, parent_id long, name string, sort_order int")
    got = folders.ancestors(tree)
    assert got.count() == n * (n + 1) // 2 and got.agg(F.max("distance")).first()[0] == n - 1
    assert [r.id for r in folders.flatten(tree).orderBy("position").collect()] == list(range(n))


def test_best_hit_of_equal_scores_comes_first(spark):
    hits = spark.createDataFrame([("d", 1, "b", "T", "second", 0.5), ("d", 0, "a", "T", "first", 0.5), ("e", 0, "c", "T", "third", 0.4)], "document_id string, ordinal int, chunk_id string, title string, text string, score double")
    assert retrieval.extractive_answer(hits).first().answer == "[T] first (3 sources)"


def test_upserts_with_ties_and_nulls(spark):
    now = spark.createDataFrame([(1, "a", 1), (None, "n", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "x", 2), (1, "y", 2), (None, "m", 2), (None, "l", 1)], "k int, v string, t int")
    expected = [(1, "y", 2), (2, "b", 1), (None, "m", 2)]
    for order in ("t", None):
        got = store.upsert(now, new.repartition(3), ["k"], order).collect()
        key = lambda r: (r[0] is None, r)
        assert sorted(map(tuple, got), key=key) == (expected if order else [(1, "y", 2), (2, "b", 1), (None, "m", 2)])
    assert {r.v for r in store.replace_group(now, new.where("k IS NULL"), ["k"]).collect()} == {"a", "b", "m", "l"}


def test_snapshots_always_have_a_current_version(spark, tmp_path, monkeypatch):
    shots = store.Snapshots(spark, f"file://{tmp_path}/t")
    rows = lambda v: spark.createDataFrame([("o", v)], "owner_id string, v int")
    with pytest.raises(FileNotFoundError):
        shots.read()
    shots.replace(rows(1))
    shots.replace(rows(2))
    assert shots.read().first().v == 2 and shots.drop_old() == 1 and shots.read().first().v == 2
    stale = store.Snapshots(spark, f"file://{tmp_path}/t")
    monkeypatch.setattr(stale, "_latest", lambda: 1)  # a writer that has not seen version 2
    with pytest.raises(RuntimeError):
        stale.replace(rows(3))
    assert shots.read().first().v == 2


def test_durable_steps():
    calls = []

    def failing(error):
        calls.append(1)
        raise error

    with pytest.raises(KeyError):
        models.durable(lambda: failing(KeyError()), sleep=lambda _: None)
    assert len(calls) == 4
    with pytest.raises(Fatal):
        models.durable(lambda: failing(Fatal()), sleep=lambda _: None)
    assert len(calls) == 5


def test_pictures_that_cannot_be_read_are_reported(spark):
    rows = [("d", k, "image/png", bytes(9 if k == 2 else 1)) for k in range(6)] + [("e", 0, "image/bad", b"x")]
    images = spark.createDataFrame(rows, "document_id string, image_index int, media_type string, data binary").coalesce(1)

    def provider(batch):
        if any(m == "image/bad" for m, _ in batch):
            raise RuntimeError("no")
        return ["{}"] * len(batch)

    got = {(r.document_id, r.image_index): (r.insight, r.problem) for r in models.read_pictures(images, provider, most_bytes=5, batch=1, most=4).collect()}
    assert got == {("d", 2): (None, "size"), ("d", 5): (None, "limit"), ("e", 0): (None, "failed")} | {("d", k): ("{}", None) for k in (0, 1, 3, 4)}


def searches(spark, broken=()):
    """A small repository: two documents, a rule bound to each, and what its providers find."""
    docs = spark.createDataFrame([("d1", "v1"), ("d2", "v2")], "document_id string, latest_version_id string")
    hits = spark.createDataFrame([("c1", "d1", "v1", 0.9), ("c2", "d2", "v2", 0.3)], "chunk_id string, document_id string, version_id string, score double")
    rules = spark.createDataFrame([(1, 0.8, 0), (2, 0.1, 1)], "rule_id long, score double, rank int")
    more = spark.createDataFrame([("c3", "d2", "v2", 0.7), ("c1", "d1", "v1", 0.9)], "chunk_id string, document_id string, version_id string, score double")

    def give(name, value):
        def run(*_):
            if name in broken:
                raise ConnectionError(name)
            return value(*_)

        return run

    return docs, give("content", lambda scope, k: hits), give("rules", lambda: rules), give("scoped", lambda paths: paths.select("path_id").crossJoin(F.broadcast(more)))


def test_search_keeps_what_was_found_before_a_failure(spark):
    nodes = spark.createDataFrame([("r1", "rule", None, 1), ("r2", "rule", None, 2), ("n1", "document", "d1", None), ("n2", "document", "d2", None)], "node_id string, node_kind string, document_id string, rule_id long")
    links = spark.createDataFrame([("l1", "n2", "r1", 0.9)], "link_id string, left_node_id string, right_node_id string, semantic_score double")

    def run(*broken):
        docs, content, rules, scoped = searches(spark, broken)
        found = search.unified_search(content, rules, scoped, documents=docs, rule_table=nodes.where("rule_id IS NOT NULL").select("rule_id"), nodes=nodes, links=links)
        return found.mode, [r.chunk_id for r in found.seeds.collect()], [(r.rule_node, r.standalone) for r in found.rules.collect()], [r.chunk_id for r in found.expanded.collect()]

    assert run() == ("expanded", ["c1", "c2"], [("r1", False)], ["c3"])
    assert run("scoped") == ("fallback", ["c1", "c2"], [("r1", True)], [])
    assert run("rules") == ("fallback", ["c1", "c2"], [], [])
    with pytest.raises(ConnectionError):
        run("content")


def test_legacy_search(spark):
    table = spark.createDataFrame([(1,), (2,)], "rule_id long")
    links = spark.createDataFrame([(1, 2, 0.6)], "left_rule_id long, right_rule_id long, vector_score double")
    bindings = spark.createDataFrame([(2, "d2", "v2"), (1, "d1", "v0")], "rule_id long, document_id string, version_id string")

    def run(*broken, scope=None):
        docs, content, rules, scoped = searches(spark, broken)
        found = search.legacy_search(content, rules, scoped, documents=docs, rule_table=table, links=links, bindings=bindings, scope=scope)
        return found.mode, [r.chunk_id for r in found.seeds.collect()], sorted((r.rule_node, r.standalone) for r in found.rules.collect()), [r.chunk_id for r in found.expanded.collect()]

    assert run() == ("expanded", ["c1", "c2"], [(1, False), (2, False)], ["c3"])
    assert run("scoped") == ("content-only", ["c1", "c2"], [(1, True)], [])
    assert run("rules") == ("fallback", ["c1", "c2"], [], [])
    none = spark.createDataFrame([], "document_id string")
    assert run(scope=none) == ("content-only", [], [], [])


def test_rule_documents_are_processed_whole(spark):
    r = random.Random(3)
    chunks = spark.createDataFrame([("doc-a", 0, 1, "Trips need approval. Meals are paid."), ("doc-b", 0, 2, "nothing here")], "document_id string, ordinal int, chunk_id long, text string")
    vector = lambda k: [1.0 if j == k else r.random() / 100 for j in range(4)]
    existing = spark.createDataFrame([(7, "doc-a", 0, "old", False, vector(0)), (8, "doc-c", 0, "kept", True, vector(1)), (9, "doc-b", 0, "stays", True, vector(3))], "rule_id long, rule_document_id string, ordinal int, statement string, enabled boolean, embedding array<double>")
    bound = spark.createDataFrame([(7, 100, 1000, 0.5), (8, 100, 1000, 0.9)], "rule_id long, document_id long, chunk_id long, vector_score double")
    linked = spark.createDataFrame([(7, 8, 0.5), (8, 9, 0.4)], "left_rule_id long, right_rule_id long, vector_score double")
    targets = spark.createDataFrame([(1000, 100, vector(1), "t"), (2000, 200, vector(2), "t")], "chunk_id long, document_id long, embedding array<double>, text string")

    def provider(batch):
        texts = {c["chunk_id"]: c["text"] for c in batch}
        said = [("Trips need approval", "Trips need approval."), ("Meals are paid", "Meals are paid."), ("made up", "not in the text")]
        return [{"source_chunk_id": str(k), "statement": s, "evidence_quote": q, "confidence": 0.9} for k, t in texts.items() if "Trips" in t for s, q in said]

    places = {"Trips need approval": vector(1), "Meals are paid": vector(2)}
    embed = lambda rows: rows.join(spark.createDataFrame(list(places.items()), "statement string, embedding array<double>"), "statement")
    got = writes.process_rule_documents(chunks, existing, bound, linked, targets, embed=embed, provider=provider)
    ids = {r.statement: r.rule_id for r in got.rules.collect()}
    assert set(ids) == {"kept", "stays", "Trips need approval", "Meals are paid"}
    assert {(r.rule_id, r.document_id) for r in got.bindings.collect()} == {(8, 100), (ids["Trips need approval"], 100), (ids["Meals are paid"], 200)}
    pairs = {frozenset((r.left_rule_id, r.right_rule_id)) for r in got.links.collect()}
    assert pairs == {frozenset((8, 9)), frozenset((8, ids["Trips need approval"]))}
    assert {r.document_id: (r.problem, r.rules, r.refused) for r in got.report.collect()} == {"doc-a": (None, 2, 1), "doc-b": ("no-rules", 0, 0)}
    manual = spark.createDataFrame([("doc-a", "Meals are paid.")], "document_id string, content string")
    places["Meals are paid."] = vector(2)
    got = writes.process_rule_documents(chunks, existing, bound, linked, targets, embed=embed, manual=manual, keep_enabled=True)
    fresh = got.rules.where("rule_document_id = 'doc-a'").collect()
    assert [(r.statement, r.enabled) for r in fresh] == [("Meals are paid.", False)]


def test_home_and_bulk_limits(spark):
    docs = spark.createDataFrame([("o", "d", "t", "knowledge"), ("o", "e", "t", "rule"), ("p", "f", "t", "rule")], "owner_id string, document_id string, title string, document_kind string").withColumn("folder_id", F.lit(None).cast("string")).withColumn("deletion_status", F.lit("active"))
    own = lambda names: spark.createDataFrame([], names)
    tables = {"documents": docs, "folders": own("owner_id string, sort_order int, name string, id string, parent_id string"), "jobs": own("owner_id string, job_id string, status string, stage string, created_at timestamp"), "grants": own("owner_id string, client_id string"), "client_permissions": own("owner_id string, client_id string, can_upload boolean")}
    got = writes.home(tables, "o")
    assert {k: v.count() for k, v in got.items()} == {"documents": 1, "folders": 0, "jobs": 0, "connections": 0, "rule_documents": 1}
    many = spark.range(1001).select(F.col("id").cast("string").alias("document_id"))
    with pytest.raises(ValueError):
        writes.bulk_delete(tables["folders"], docs, spark.createDataFrame([], "id string"), many, spark.createDataFrame([], "document_id string, message string"))


def test_names_in_composed_form(spark):
    decomposed = "re\u0301sume\u0301"
    files = spark.createDataFrame([(f"top/{decomposed}/a.txt",), ("top/résumé/b.txt",)], "relative_path string")
    assert sorted(r.path for r in folders.upload_plan(files).collect()) == ["top", "top/résumé"]
