"""Queries over a repository: listings, counts, orders, pages, lookups and stored-row projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import composed, like_term, natural_key
from folioforge.session import numbered

#: States and stages of ingestion, stages in their order, states of a version.
JOB_STATUSES = ("uploading", "queued", "processing", "ready", "failed")
JOB_STAGES = ("uploading", "queued", "parsing", "ocr", "chunking", "indexing", "ready", "failed")
VERSION_STATUSES = ("uploaded", "parsing", "indexing", "ready", "failed")
SOURCE_TYPES = ("pdf", "docx", "xlsx", "markdown", "html", "text")


def owned(rows: DataFrame, owner_id) -> DataFrame:
    """The rows of one owner; every read starts here."""
    return rows.where(F.col("owner_id") == owner_id)


def may_write(claims: DataFrame) -> DataFrame:
    """claims with `allowed`: writes are refused to sessions that a third-party client opened."""
    return claims.withColumn("allowed", F.coalesce(F.col("client_id"), F.lit("")) == "")


def latest_versions(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each document."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return versions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def indexed_documents(documents: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """documents with their latest version and `chunks` in order (an empty list where there are none)."""
    per = chunks.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "text"))).alias("chunks"))
    current = versions.select(F.col("version_id").alias("latest_version_id"), "status", "original_filename", "size_bytes")
    rows = documents.join(current, "latest_version_id").join(per.withColumnRenamed("version_id", "latest_version_id"), "latest_version_id", "left")
    return rows.withColumn("chunks", F.coalesce("chunks", F.array().cast(per.schema["chunks"].dataType)))


def document_outline(documents: DataFrame, versions: DataFrame, chunks: DataFrame, document_id) -> DataFrame:
    """One document with its version and the places of its chunks, without texts; no row if it is gone or has no version."""
    live = documents.where((F.col("document_id") == document_id) & (F.coalesce("deletion_status", F.lit("active")) == "active"))
    got = indexed_documents(live, versions, chunks)
    return got.withColumn("chunks", F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["ordinal"].alias("ordinal"))))


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == value)


def sort_documents(documents: DataFrame, by: str = "name") -> list[Column]:
    """Order of a listing: natural name (title, then file name), most recent first, or source type; then name and id."""
    name = [natural_key(F.col("title")), natural_key(F.col("original_filename"))] if "original_filename" in documents.columns else [natural_key(F.col("title"))]
    first = {"name": [], "recent": [F.col("indexed_at").desc()], "type": [F.col("source_type")]}[by]
    return [*first, *name, F.col("document_id")]


def sort_folders(by: str = "name") -> list[Column]:
    """As for documents; folders have no type, so that falls back to the name."""
    return [*([F.col("updated_at").desc()] if by == "recent" else []), natural_key(F.col("name")), F.col("id")]


def positions(documents: DataFrame, order: list[Column]) -> DataFrame:
    """(document_id, position) of every row, from 1. Sorted ranges are counted and numbered, so no task holds all rows."""
    return numbered(documents, order, "_place").select("document_id", (F.col("_place") + 1).alias("position"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page; a number outside is moved to the nearest page. Sizes are 10, 30 or 50."""
    if size not in (10, 30, 50):
        raise ValueError("pages have 10, 30 or 50 rows")
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(1, number), pages) - 1) * size).limit(size)


def search_titles(documents: DataFrame, term: str) -> DataFrame:
    return documents.where(F.lower(F.concat_ws(" ", "title", "original_filename")).contains(term.strip().lower()))


def titles_like(documents: DataFrame, term: str) -> DataFrame:
    return documents.where(F.col("title").ilike(like_term(term)))


def stored_job(jobs: DataFrame) -> DataFrame:
    """Jobs as shown: a status or stage that is not known counts as failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*JOB_STATUSES), F.col("status")).otherwise("failed")).withColumn(
        "stage", F.when(F.col("stage").isin(*JOB_STAGES), F.col("stage")).otherwise("failed")
    )


def filter_jobs(jobs: DataFrame, kind: str = "all") -> DataFrame:
    if kind == "all":
        return jobs
    if kind == "running":
        return jobs.where(~F.col("status").isin("ready", "failed"))
    return jobs.where(F.col("status") == kind)


def job_counts(jobs: DataFrame, *keys: str) -> DataFrame:
    """(running, ready, failed) of the jobs, for each key if there are any."""
    s = F.col("status")
    aggs = [F.count_if(~s.isin("ready", "failed")).alias("running"), F.count_if(s == "ready").alias("ready"), F.count_if(s == "failed").alias("failed")]
    return jobs.groupBy(*keys).agg(*aggs) if keys else jobs.agg(*aggs)


def can_resume(now: Column) -> Column:
    """Whether an upload may be taken up again: still uploading, both ids there, no run yet, idle for 30 seconds."""
    there = F.col("document_id").isNotNull() & F.col("version_id").isNotNull() & F.col("workflow_run_id").isNull()
    return (F.col("status") == "uploading") & (F.col("stage") == "uploading") & there & (F.unix_millis(now) - F.unix_millis(F.col("updated_at").cast("timestamp")) >= 30_000)


def same_upload(job: str = "j", file: str = "f") -> Column:
    """Whether a file is the one a failed job has lost: same name, type and size."""
    return (F.col(f"{job}.status") == "failed") & ~F.col(f"{job}.original_available") & (composed(F.col(f"{job}.file_name")) == composed(F.col(f"{file}.file_name"))) & (F.col(f"{job}.mime_type") == F.col(f"{file}.mime_type")) & (F.col(f"{job}.size_bytes") == F.col(f"{file}.size_bytes"))


def version_status(status: Column) -> Column:
    return F.when(status.isin(*VERSION_STATUSES), status).otherwise("uploaded")


def stored_document(rows: DataFrame) -> DataFrame:
    """Stored chunk rows with the defaults of missing metadata: start 0, end = start, focus = end, type text."""
    start = F.coalesce("block_start", F.lit(0))
    end = F.coalesce("block_end", start)
    kind = F.when(F.col("source_type").isin(*SOURCE_TYPES), F.col("source_type")).otherwise("text")
    return rows.withColumn("block_start", start).withColumn("block_end", end).withColumn("focus_block", F.coalesce("focus_block", end)).withColumn("source_type", kind)


_SPAN = "array<struct<blockId:string,blockIndex:int,startOffset:int,endOffset:int,startWord:int,endWord:int,page:int,sheet:string,cellRange:string,imageIndex:int,boxes:array<struct<x:double,y:double,width:double,height:double>>>>"


def parse_spans(text: Column) -> Column:
    """Spans from JSON; items without id, index or a proper range are left out, as are boxes that are not within the page."""
    good = F.filter(
        F.from_json(text, _SPAN),
        lambda s: s["blockId"].isNotNull() & (s["blockIndex"] >= 0) & (s["startOffset"] >= 0) & (s["endOffset"] >= s["startOffset"]),
    )
    unit = lambda b: (b["x"] >= 0) & (b["y"] >= 0) & (b["width"] > 0) & (b["height"] > 0)
    return F.coalesce(F.transform(good, lambda s: s.withField("boxes", F.filter(s["boxes"], unit))), F.array().cast(_SPAN))


def document_title(kind: Column, manual_title: Column, parsed: Column, filename: Column) -> Column:
    """Rules typed by hand keep their title (else the parsed one); uploads show their file name."""
    return F.when(kind == "manual", F.coalesce(F.nullif(F.trim(manual_title), F.lit("")), parsed)).otherwise(filename)


def rule_listing(documents: DataFrame, rule_documents: DataFrame, versions: DataFrame, jobs: DataFrame, rules: DataFrame, semantic: DataFrame, legacy: DataFrame) -> DataFrame:
    """Rule documents with version, newest job, number of rules and of documents they reach.

    semantic(rule_document_id, documents) is preferred to legacy(rule_document_id, documents).
    """
    newest = latest_versions(jobs, "document_id", ["created_at", "job_id"]).select("document_id", F.col("status").alias("job_status"), F.col("stage").alias("job_stage"))
    counts = rules.groupBy("rule_document_id").agg(F.count(F.lit(1)).alias("rules"), F.count_if("enabled").alias("enabled_rules"))
    rows = documents.where("document_kind = 'rule'").withColumn("rule_document_id", F.col("document_id")).join(rule_documents, "rule_document_id", "left")
    rows = rows.join(versions.select(F.col("version_id").alias("latest_version_id"), F.col("status").alias("version_status")), "latest_version_id", "left").join(newest, "document_id", "left")
    rows = rows.join(counts, "rule_document_id", "left").join(semantic.withColumnRenamed("documents", "_s"), "rule_document_id", "left").join(legacy.withColumnRenamed("documents", "_l"), "rule_document_id", "left")
    return rows.withColumn("rules", F.coalesce("rules", F.lit(0))).withColumn("enabled_rules", F.coalesce("enabled_rules", F.lit(0))).withColumn("reachable", F.coalesce("_s", "_l", F.lit(0))).drop("_s", "_l")


def relations_of_rules(nodes: DataFrame, links: DataFrame, evidence: DataFrame, chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """(node_id, other_node, other_kind, semantic_score, title, chunk_id, text): each link from both ends with its first evidence."""
    first = evidence.where("ordinal = 0").select("link_id", "left_chunk_id", "right_chunk_id")
    rows = links.join(first, "link_id", "left")
    ways = rows.select("link_id", "semantic_score", F.explode(F.array(
        F.struct(F.col("left_node_id").alias("node_id"), F.col("right_node_id").alias("other_node"), F.col("right_chunk_id").alias("chunk_id")),
        F.struct(F.col("right_node_id").alias("node_id"), F.col("left_node_id").alias("other_node"), F.col("left_chunk_id").alias("chunk_id")),
    )).alias("w")).select("link_id", "semantic_score", "w.*")
    ways = ways.join(nodes.where("node_kind = 'rule'").select("node_id"), "node_id", "left_semi")
    others = nodes.select(F.col("node_id").alias("other_node"), F.col("node_kind").alias("other_kind"), "document_id")
    return ways.join(others, "other_node").join(chunks.select("chunk_id", "text"), "chunk_id", "left").join(titles, "document_id", "left")


def connections(grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """Grants of clients with whether each may upload."""
    return grants.join(permissions.select("owner_id", "client_id", "can_upload"), ["owner_id", "client_id"], "left").withColumn("can_upload", F.coalesce("can_upload", F.lit(False)))


def version_gate(rows: DataFrame, key: str, generation: str) -> DataFrame:
    """Of answers that came back for a key the one of the latest request; the stale ones go."""
    payload = [c for c in rows.columns if c not in (key, generation)]
    # Of answers to one request the greatest in column order stays, so reruns agree.
    return rows.groupBy(key).agg(F.max(F.struct(generation, *payload)).alias("_p")).select(key, "_p.*")
