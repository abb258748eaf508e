import json

import pytest
from pyspark.sql import functions as F

from folioforge.api import NotAllowed, Repository
from folioforge.operators import models, search
from folioforge.sources import dispatch, html
from folioforge.streaming import jobs

U = [f"{k}1111111-1111-4111-8111-111111111111" for k in range(6)]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "documents": spark.createDataFrame([("o", U[0], "Remote work", "v1", None, 1, "active"), ("o", U[1], "Travel", "v2", U[5], 2, "active"), ("o", U[2], "Gone", "v3", None, 3, "deleting"), ("p", U[3], "Remote work", "v4", None, 1, "active")], "owner_id string, document_id string, title string, latest_version_id string, folder_id string, sort_order long, deletion_status string"),
        "document_versions": spark.createDataFrame([("o", v, d, "ready", "f.md", 1, f"o/{d}/x/x.md") for v, d in (("v1", U[0]), ("v2", U[1]))], "owner_id string, version_id string, document_id string, status string, original_filename string, size_bytes long, storage_path string"),
        "document_chunks": spark.createDataFrame([("o", U[0], "v1", "c1", 0, "work from home", ["A"]), ("o", U[0], "v0", "c0", 0, "work old", ["A"]), ("o", U[1], "v2", "c2", 0, "work abroad", []), ("p", U[3], "v4", "c4", 0, "work", [])], "owner_id string, document_id string, version_id string, chunk_id string, ordinal int, text string, heading_path array<string>"),
        "folders": spark.createDataFrame([("o", U[5], None, "Trips", 0)], "owner_id string, id string, parent_id string, name string, sort_order long"),
        "document_ingestion_jobs": spark.createDataFrame([("o", "j1", U[0], "v1", "uploading", "strange")], "owner_id string, job_id string, document_id string, version_id string, status string, stage string"),
        "client_permissions": spark.createDataFrame([("o", "app", True)], "owner_id string, client_id string, can_upload boolean"),
    }


def test_reading_tools(tables):
    r = Repository(tables, "o")
    assert [x["chunk_id"] for x in r.search_repository("remote work")["results"]] == ["c1", "c2"]
    assert [x["chunk_id"] for x in r.search_repository("work", folder_id=U[5])["results"]] == ["c2"]
    assert [x["chunk_id"] for x in r.search_repository("work", document_ids=[U[0], U[3]])["results"]] == ["c1"]
    assert [d["document_id"] for d in r.list_documents()["documents"]] == [U[0]] and len(r.list_folders()["folders"]) == 1
    assert r.get_document(U[0])["document"]["chunks"] == [{"chunk_id": "c1", "ordinal": 0}] and r.get_document(U[2])["document"] is None
    assert r.get_chunk("c1")["chunk"]["text"] == "work from home" and r.get_chunk("c4")["chunk"] is None
    assert r.get_ingestion_status("j1")["ingestion"]["stage"] == "failed"
    with pytest.raises(ValueError):
        r.list_documents(size=1001)


def test_originals_of_another_version_are_refused(tables):
    paths = tables["document_versions"].withColumn("storage_path", F.when(F.col("version_id") == "v1", F.concat_ws("/", "owner_id", "document_id", "version_id", F.lit("f.md"))).otherwise(F.col("storage_path")))
    r = Repository(tables | {"document_versions": paths}, "o")
    assert r.get_original(U[0])["original"]["storage_path"] == f"o/{U[0]}/v1/f.md" and r.get_original(U[1])["original"] is None


def test_writing_tools(tables):
    up = Repository(tables, "o", "app").create_upload("a.pdf", "", 5)["upload"]
    assert up["source_type"] == "pdf" and up["storage_path"].startswith("o/")
    with pytest.raises(NotAllowed):
        Repository(tables, "o", "other").create_upload("a.pdf", "", 5)
    with pytest.raises(ValueError):
        Repository(tables, "o").create_upload("a.pdf", "", 11 << 20)
    assert Repository(tables, "o").complete_upload(U[0], "v1", "j1")["processing"]["started"]


def test_files_to_blocks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\ntext\n")
    (tmp_path / "b.html").write_text("<h1>Page</h1><p>body")
    (tmp_path / "c.docx").write_text("broken")
    (tmp_path / "d.bin").write_text("?")
    blocks, docs = dispatch.parse_files(dispatch.read_files(spark, str(tmp_path)))
    found = {r.name: r for r in docs.collect()}
    assert {n: r.title for n, r in found.items()} == {"a.md": "Title", "b.html": "Page", "c.docx": "c", "d.bin": "d"}
    assert found["c.docx"].error and found["d.bin"].error == "unknown type" and not found["a.md"].error
    assert sorted(r.text for r in blocks.collect()) == ["Page", "Title", "body", "text"]


def test_sanitiser():
    dirty = '<p onclick="x()">a &amp; b<script>alert(1)</script><a href="http://e">l</a><a href="#t">m</a><img src="http://e"><form><b>f</b></form></p>'
    assert html.sanitise(dirty) == '<p>a &amp; b<a>l</a><a href="#t">m</a><img></p>'


def test_providers(spark):
    chunks = spark.createDataFrame([("d", 0, "c1", "Orders need approval"), ("d", 1, "c2", "x")], "document_id string, ordinal int, chunk_id string, text string")
    provider = lambda rows: [{"source_chunk_id": rows[0]["chunk_id"], "statement": rows[0]["text"], "evidence_quote": "need", "confidence": 0.9}]
    assert [r.source_chunk_id for r in models.extract_rules(chunks, provider).collect()] == ["c1"]
    from pyspark.sql import functions as F

    said = json.dumps({"visibleText": " SALE ", "description": "", "keyFacts": ["a", " ", "b"]})
    got = spark.range(1).select(models.insight_text(F.lit(said)).alias("a"), models.insight_text(F.lit("{}")).alias("b")).first()
    assert (got.a, got.b) == ("Text: SALE\nFacts: a; b", "")
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert models.retried(flaky, sleep=waits.append) == "ok" and waits == [0.25, 0.75]


def test_rule_evidence_and_maintenance(spark):
    applied = spark.createDataFrame([("r1", "d", "c", 0.5, 0), ("r2", "d", "c", 0.4, 1)], "rule_id string, rule_document_id string, source_chunk_id string, score double, position int")
    chunks = spark.createDataFrame([("c", "d", "v", "t", [])], "chunk_id string, document_id string, version_id string, text string, heading_path array<string>")
    docs = spark.createDataFrame([("d", "T", "knowledge", "v", "active")], "document_id string, title string, document_kind string, latest_version_id string, deletion_status string")
    assert [(r.rule_id, r.title) for r in search.rule_evidence(applied, chunks, docs).collect()] == [("r2", "T")]
    old, new = jobs.reindex_plan(docs, chunks, chunks)
    assert old.count() == new.count() == 1
    renamed = jobs.renamed(docs, chunks, spark.createDataFrame([("d", "New")], "document_id string, new_title string"))
    assert renamed[0].first().title == "New" and renamed[1].first().sparse_text == "New\nt"
