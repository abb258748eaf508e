import pytest
from pyspark.sql import functions as F

from folioforge.config import threshold
from folioforge.functions import ids, scores, sheets
from folioforge.functions import text as T
from folioforge.operators import answers, folders, repository, retrieval, rules, search, semantic, spans
from folioforge.streaming import jobs, progress


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_lexical_search(spark):
    rows = spark.createDataFrame(
        [("d", "chunk-1", 0, "Remote work", ["Apply"], "remote work request standard", "ready"), ("d", "chunk-2", 1, "Remote work", ["Cost"], "travel", "ready"), ("e", "chunk-3", 0, "x", [], "request", "deleting")],
        "document_id string, chunk_id string, ordinal int, title string, heading_path array<string>, text string, status string",
    )
    got = retrieval.lexical_search(rows, "remote work request standard").collect()
    assert got[0].chunk_id == "chunk-1" and got[0].score == pytest.approx(0.99)
    assert retrieval.lexical_search(rows, "remote work request", 1).count() == 1
    empty = retrieval.lexical_search(rows, "nothing")
    assert empty.count() == 0 and retrieval.extractive_answer(empty).first().answer == retrieval.REFUSAL
    assert retrieval.lexical_search(rows, "!").count() == 0 and retrieval.lexical_search(rows, "request", 0).count() == 0


def test_search_request():
    u = "11111111-1111-4111-8111-111111111111"
    assert retrieval.parse_search_request(" q ", [u, u], None) == {"query": "q", "document_ids": [u], "folder_id": None, "top_k": 8}
    for bad in (("",), ("q", ["x"]), ("q", None, "x"), ("q", None, None, 0), ("q", None, None, True), ("x" * 2001,)):
        with pytest.raises(ValueError):
            retrieval.parse_search_request(*bad)


def test_fusion_scores(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "chunk_id string, rank0 int")
    b = spark.createDataFrame([("x", 0), ("z", 2)], "chunk_id string, rank0 int")
    got = {r.chunk_id: r.score for r in retrieval.rrf_fuse([a, b], 10).collect()}
    assert got == {"x": pytest.approx(1.0), "y": pytest.approx(1 / 3), "z": pytest.approx(0.25)}
    with pytest.raises(ValueError):
        retrieval.hybrid_search(a, a, 1, [1.0], " ")


def test_calibration(spark):
    got = one(spark, a=scores.calibrated(F.lit(0.85)), b=scores.calibrated(F.lit(0.91)), c=scores.calibrated(F.lit(0.86)), d=scores.calibrated(F.lit(0.86), "other"), e=scores.pair_floor(F.lit(0.35)))
    assert got.a == 0 and got.b > 0.35 and got.c < 0.35 and got.d == 0.86 and got.e == pytest.approx(0.1875)


def test_thresholds():
    assert threshold("T", 0.2, {"T": "0.5"}) == 0.5 and threshold("T", 0.2, {"T": "x"}) == 0.2 and threshold("T", 0.2, {"T": "2"}) == 0.2 and threshold("T", 0.2, {}) == 0.2


def test_natural_order(spark):
    rows = spark.createDataFrame([("문서 10",), ("문서 2",), ("가이드",)], "title string").withColumn("document_id", F.col("title"))
    assert [r.title for r in rows.orderBy(*repository.sort_documents(rows)).collect()] == ["가이드", "문서 2", "문서 10"]


def test_ids_and_sheets(spark):
    got = one(spark, u=ids.stable_uuid(F.lit("a")), n=sheets.column_number(F.lit("AA")), l=sheets.column_letters(F.lit(703)), r=sheets.parse_range(F.lit("$C$5:a1")), bad=sheets.parse_range(F.lit("1A")))
    assert got.u[14] == "5" and got.u[19] in "89ab" and len(got.u) == 36
    assert (got.n, got.l, tuple(got.r), got.bad) == (27, "AAA", (1, 1, 3, 5), None)


def test_text_functions(spark):
    got = one(spark, t=T.query_terms(F.lit("A bc BC d-ef")), c=T.collapse(F.lit(" a \t b\n")), e=T.html_escape(F.lit("<a & 'b'>")), i=T.text_for_index(F.lit("T"), F.array(F.lit("x"), F.lit(None)), F.lit(" ")))
    assert got.t == ["bc", "ef"] and got.c == "a b" and got.e == "&lt;a &amp; &#39;b&#39;&gt;" and got.i == "T\nx"


# --- folders ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("a", None, "A", 0), ("b", "a", "B 10", 0), ("c", "a", "B 2", 0), ("d", "b", "D", 0), ("o", "gone", "Orphan", 0)]
    return spark.createDataFrame(rows, "id string, parent_id string, name string, sort_order long")


def test_tree(spark, tree):
    got = [(r.id, r.depth) for r in folders.flatten(tree).orderBy("position").collect()]
    assert got == [("a", 0), ("c", 1), ("b", 1), ("d", 2), ("o", 0)]
    paths = {r.id: r.path for r in folders.folder_paths(tree).collect()}
    assert paths["d"] == ["a", "b", "d"] and paths["o"] == ["o"]
    docs = spark.createDataFrame([("x", "a"), ("y", "d"), ("z", None)], "document_id string, folder_id string")
    assert {r.document_id for r in folders.documents_in_scope(docs, tree, "a").collect()} == {"x", "y"}
    assert {r.document_id for r in folders.documents_in_scope(docs, tree, "a", recursive=False).collect()} == {"x"}
    assert {r.document_id for r in folders.documents_in_scope(docs, tree).collect()} == {"z"}
    moves = spark.createDataFrame([("a", "d"), ("d", "c"), ("b", None)], "id string, target string")
    assert {(r.id, r.allowed) for r in folders.can_move(tree, moves).collect()} == {("a", False), ("d", True), ("b", True)}
    with pytest.raises(ValueError):
        folders.search_scope(docs, tree, "nope")


def test_cycles_end(spark):
    loop = spark.createDataFrame([("a", "b", "A", 0), ("b", "a", "B", 0)], "id string, parent_id string, name string, sort_order long")
    assert {(r.id, r.ancestor) for r in folders.ancestors(loop).collect()} == {("a", "a"), ("a", "b"), ("b", "b"), ("b", "a")}


def test_deletion_and_upload(spark, tree):
    docs = spark.createDataFrame([("x", "d")], "document_id string, folder_id string")
    f, d, r = folders.deletion_targets(tree, docs, spark.createDataFrame([("a",), ("d",)], "id string"))
    assert {x.id for x in f.collect()} == {"a", "b", "c", "d"} and d.count() == 1 and [x.id for x in r.collect()] == ["a"]
    with pytest.raises(ValueError):
        folders.deletion_targets(tree, docs, spark.createDataFrame([("nope",)], "id string"))
    entries = spark.createDataFrame([("Top/x/a.md",), ("Top/b.md",)], "relative_path string")
    plan = folders.upload_plan(entries)
    assert [(p.path, p.depth) for p in plan.collect()] == [("Top", 1), ("Top/x", 2)]
    for bad in ("Top/../a", "Top//a"):
        with pytest.raises(ValueError):
            folders.upload_plan(spark.createDataFrame([(bad,)], "relative_path string"))
    mine = spark.createDataFrame([("t", None, "top", 0)], "id string, parent_id string, name string, sort_order long")
    made = {m.path: m for m in folders.ensure_tree(mine, plan, "o").collect()}
    assert made["Top"].id == "t" and not made["Top"].created and made["Top/x"].parent_id == "t" and made["Top/x"].created


# --- rules and graph --------------------------------------------------------------------------------------------------


def test_spans():
    assert rules.find_span("저는 좋은 서포터와 정글러가", "정글러") == ("정글러", 11, 14)
    assert rules.find_span("a  b\nc", "a b c") == ("a  b\nc", 0, 6)
    assert rules.find_span("café", "café") == ("café", 0, 4)
    assert rules.find_span("abc", "x") is None and rules.find_span(None, "x") is None


def test_candidates(spark):
    chunks = spark.createDataFrame([("c1", "All orders need approval today")], "chunk_id string, text string")
    rows = [("d", 0, "c1", "Orders need approval", "orders need approval", 0.9), ("d", 1, "c1", "ORDERS need approval", "All orders", 0.9), ("d", 2, "c1", "x", "missing", 0.9), ("d", 3, "c1", "y", "today", 0.59), ("d", 4, "c9", "z", "today", 0.9)]
    got = rules.validate_candidates(spark.createDataFrame(rows, "document_id string, position int, source_chunk_id string, statement string, evidence_quote string, confidence double"), chunks).orderBy("position").collect()
    assert [r.reason for r in got] == [None, "duplicate", "evidence", "confidence", "chunk"] and got[0].ordinal == 0 and (got[0].start_offset, got[0].end_offset) == (4, 24)


def test_rule_paths(spark):
    roots = spark.createDataFrame([("r1", 0.9), ("r2", 0.4)], "rule_id string, score double")
    links = spark.createDataFrame([("r1", "r3", 0.7), ("r1", "r1", 1.0)], "left_rule_id string, right_rule_id string, vector_score double")
    bound = spark.createDataFrame([("r1", "d1"), ("r3", "d2"), ("r2", "d3")], "rule_id string, document_id string")
    got = [(r.path_id, round(r.score, 3), r.document_ids) for r in rules.rule_paths(roots, links, bound).collect()]
    assert got == [("r1", 0.9, ["d1"]), ("r1>r3", 0.8, ["d2"])]


def test_representatives(spark):
    rows = [("d", i, f"c{i}", f"t{i}", ["A"] if i < 20 else ["B"]) for i in range(30)] + [("e", i, f"e{i}", "t", []) for i in range(5)]
    got = semantic.representatives(spark.createDataFrame(rows, "document_id string, ordinal int, chunk_id string, text string, heading_path array<string>"))
    d = sorted(r.ordinal for r in got.where("document_id = 'd'").collect())
    assert len(d) == 12 and {0, 20, 29} <= set(d) and got.where("document_id = 'e'").count() == 5


def test_link_aggregation(spark):
    raw = [0.94, 0.93, 0.925, 0.91]
    m = [("o", "m", f"s{min(i, 2)}", "n1", f"t{min(i, 2)}" if i < 3 else "t0", "n2", x) for i, x in enumerate(raw)]
    matches = spark.createDataFrame(m, "owner_id string, embedding_model string, segment string, node string, other string, other_node string, raw double")
    nodes = spark.createDataFrame([("n1", 3), ("n2", 3)], "node_id string, segment_count int")
    got = semantic.link_candidates(matches, nodes).first()
    assert got.n_pairs == 3 and got.coverage == 1.0 and got.score == pytest.approx(0.8 * sum(raw[:3]) / 3 + 0.2)
    order = spark.createDataFrame([("n1", 2), ("n2", 1)], "node_id string, position int")
    link = semantic.rebuild_links(semantic.link_candidates(matches, nodes), order).first()
    assert (link.left_node_id, link.right_node_id) == ("n1", "n2") and len(link.evidence) == 3
    assert semantic.rebuild_links(semantic.link_candidates(matches, nodes), spark.createDataFrame([("n1", 1), ("n2", 2)], "node_id string, position int")).count() == 0


def test_search_policies(spark):
    r = spark.createDataFrame([("r", 0.4)], "node_id string, score double")
    d = spark.createDataFrame([("x", 0.6), ("y", 0.4)], "node_id string, score double")
    assert [x.node_id for x in search.root_candidates(r, d).collect()] == ["r"]
    assert [x.node_id for x in search.root_candidates(r.limit(0), d).collect()] == ["x"]
    seeds = spark.createDataFrame([("c1", "d1", 0.6), ("c2", "d2", 0.3), ("c3", "d3", 0.3)], "chunk_id string, document_id string, score double")
    paths = spark.createDataFrame([("d2",)], "document_id string")
    flag = lambda v: spark.range(1).select(F.lit(v).alias("flag"))
    assert {x.chunk_id for x in search.prune_seeds(seeds, paths, flag(True)).collect()} == {"c1", "c2"}
    assert search.prune_seeds(seeds, paths, flag(False)).count() == 3
    hits = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 2), ("c1", 0.9, 1)], "chunk_id string, score double, path_rank int")
    assert [(x.chunk_id, x.path_rank) for x in search.best_per_chunk(hits, seeds).collect()] == [("a", 1)]


def test_answers(spark):
    sources = spark.createDataFrame([("q", 1, "c1", "aaaa"), ("q", 2, "c2", " "), ("q", 3, "c3", "bbbb"), ("q", 4, "c4", "cc")], "request_id string, position int, chunk_id string, text string")
    assert [(r.chunk_id, r.text) for r in answers.pack_context(sources, chars=6).orderBy("position").collect()] == [("c1", "aaaa"), ("c3", "bb")]
    given = spark.createDataFrame([("q", "yes", ["c3", "zz", "c3", "c1"], False), ("p", "yes", ["c1"], False)], "request_id string, answer string, citation_chunk_ids array<string>, insufficient_evidence boolean")
    got = {r.request_id: (r.citation_chunk_ids, r.insufficient_evidence) for r in answers.verify_citations(given, sources).collect()}
    assert got == {"q": (["c3", "c1"], False), "p": ([], True)}


def test_highlights(spark):
    rows = spark.createDataFrame([(1, "abcdefgh", [(4, 6), (5, 99), (-3, 2), (7, 7)])], "k int, text string, spans array<struct<start:int,end:int>>")
    assert [(r.piece, r.marked) for r in spans.slices(rows, "k").orderBy("n").collect()] == [("ab", True), ("cd", False), ("efgh", True)]
    cells = spark.createDataFrame([("d", "s", r, c, "x") for r, c in ((1, 1), (2, 3), (4, 2))], "document_id string, sheet string, row int, column int, text string")
    assert [tuple(r)[2:] for r in spans.sheet_regions(cells).orderBy("region").collect()] == [(0, 1, 2, 1, 3), (1, 4, 4, 2, 2)]


def test_parse_spans(spark):
    raw = '[{"blockId":"b","blockIndex":0,"startOffset":1,"endOffset":3,"boxes":[{"x":0.1,"y":0.1,"width":0.2,"height":0},{"x":0,"y":0,"width":1,"height":1}]},{"blockId":"b","startOffset":1},{"x":1}]'
    got = one(spark, s=repository.parse_spans(F.lit(raw)), none=repository.parse_spans(F.lit("no"))).asDict()
    assert len(got["s"]) == 1 and len(got["s"][0].boxes) == 1 and got["none"] == []


# --- jobs and streams -------------------------------------------------------------------------------------------------

EVENTS = [("claim", "t1", None, False), ("stage", "t1", "chunking", False), ("stage", "t1", "parsing", False), ("claim", "t2", None, False), ("failure", "t1", "x" * 600, True), ("claim", "t1", None, False), ("failure", "t1", "bad", False), ("claim", "t3", None, False), ("ready", "t1", None, False), ("ready", "t3", None, False)]


def test_replay_matches_plain_steps(spark):
    rows = [("j", i, *e) for i, e in enumerate(EVENTS)]
    got = jobs.replay(spark.createDataFrame(rows, "job_id string, seq int, kind string, token string, error string, retryable boolean")).first().asDict()
    state = dict(jobs.FIRST)
    for e in EVENTS:
        state = jobs.advance(state, *e)
    assert {k: got[k] for k in state} == state
    assert state["status"] == "ready" and state["attempts"] == 3 and state["refused"] == 3


def test_stream_of_jobs(spark, tmp_path):
    schema = "job_id string, seq int, kind string, token string, error string, retryable boolean"
    spark.createDataFrame([("j", i, *e) for i, e in enumerate(EVENTS)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    found = jobs.stream_jobs(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    run = found.writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(90)
    assert [(r.status, r.attempts) for r in spark.table("job_states").collect()] == [("ready", 3)]


def test_progress_parser():
    p = progress.Parser()
    assert p.push('{"type":"progress","sta') == []
    assert p.push('ge":"ranking"}\n{"type":"error","error":"x"}') == [{"type": "progress", "stage": "ranking"}]
    assert p.finish() == [{"type": "error", "error": "x"}] and p.finish() == []
    for bad in ("{\n", '{"type":"other"}\n'):
        with pytest.raises(ValueError):
            progress.Parser().push(bad)
    assert list(progress.write_lines([{"a": 1}])) == ['{"a": 1}\n']


def test_deletion_and_cleanup(spark):
    docs = spark.createDataFrame([("d", "o", "active"), ("e", "o", "active")], "document_id string, owner_id string, deletion_status string")
    versions = spark.createDataFrame([("d", "2", "p2", "ready"), ("d", "1", "p1", "uploaded")], "document_id string, created_at string, storage_path string, status string")
    hidden, todo = jobs.request_deletion(docs, versions, docs.where("document_id = 'd'"))
    assert todo.first().storage_paths == ["p1", "p2"] and todo.first().requires_vector_cleanup
    assert {r.document_id: r.deletion_status for r in hidden.collect()} == {"d": "deleting", "e": "active"}
    assert [r.document_id for r in jobs.complete_deletion(docs, todo).collect()] == ["e"]
    rows = spark.sql("SELECT 'a' AS id, 'failed' AS status, timestamp '2024-01-01 00:00:00' AS cleanup_started_at UNION ALL SELECT 'b', 'failed', timestamp '2024-01-01 00:09:00' UNION ALL SELECT 'c', 'ready', null")
    got = {r.id: r.claimed for r in jobs.claim_cleanups(rows, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_nearest_in_blocks(spark, monkeypatch):
    import numpy as np

    from folioforge.operators import nearest

    monkeypatch.setattr(nearest, "BLOCK", 7)
    m = np.random.default_rng(2).normal(size=(40, 5))
    m[3] = 0.0
    m[9] = m[8]
    rows = spark.createDataFrame([("o", i, i // 4, [float(x) for x in m[i]]) for i in range(40)], "owner string, id long, grp long, vector array<double>")
    got = {}
    for r in nearest.nearest(rows, rows, 6, 0.1, ["owner"], other_group=True).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    for i in range(40):
        s = np.round(unit @ unit[i], 9)
        near = [int(j) for j in sorted(range(40), key=lambda j: (-s[j], j)) if j // 4 != i // 4 and s[j] >= 0.1 and 3 not in (i, j)][:6]
        assert [got.get(i, {}).get(k) for k in range(1, len(near) + 1)] == near and len(got.get(i, {})) == len(near)
    assert nearest.nearest(rows.limit(0), rows, 3, keys=["owner"]).count() == 0


@pytest.mark.parametrize(("order", "shown", "key", "source"), [("doc_order_natural", "doc_sort_natural", "p_partkey", "part"), ("doc_order_recent", "doc_sort_recent", "document_id", "orders")])
def test_every_row_has_its_position(spark, sf, order, shown, key, source):
    from folioforge import catalog

    got = {r.position: r.document_id for r in catalog.queries()[order](spark, sf).collect()}
    assert sorted(got) == list(range(1, spark.read.parquet(f"{sf}/{source}.parquet").count() + 1))
    first = [r[key] for r in catalog.queries()[shown](spark, sf).collect()]
    assert [got[k + 1] for k in range(len(first))] == first


def test_graph_queries_run_on_semantic_links(spark, sf):
    from collections import Counter

    from folioforge import catalog

    q = {n: catalog.queries()[n](spark, sf).collect() for n in ("semantic_links_rebuild", "node_degree_semantic", "one_hop_semantic", "graph_view")}
    links = [(r.link_id, r.left_node_id, r.right_node_id) for r in q["semantic_links_rebuild"]]
    degree = Counter(n for _, a, b in links for n in (a, b))
    assert links and {r.node_id: r.relation_count for r in q["node_degree_semantic"]} == degree
    near = {"3", "4"} | {b for _, a, b in links if a in ("3", "4")} | {a for _, a, b in links if b in ("3", "4")}
    assert {r.link_id for r in q["one_hop_semantic"]} == {i for i, a, b in links if a in near and b in near}
    rule = lambda n: int(n) % 3 == 0
    shown = Counter(n for _, a, b in links if not (rule(a) and rule(b)) for n in (a, b))
    nodes = {str(r.vec_id // 10) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert {r.node_id: r.relation_count for r in q["graph_view"]} == {n: shown[n] for n in nodes if not rule(n) or shown[n]}
