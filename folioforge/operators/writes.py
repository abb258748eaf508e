"""Writes as set-based checks and rewrites: folders, documents, toggles, cleanups, deletions, rule documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import DEFAULTS
from folioforge.functions.ids import stable_uuid
from folioforge.functions.text import SPACE, html_escape, trimmed
from folioforge.operators import models, repository, rules
from folioforge.sources import detect
from folioforge.sources.commits import Repository, Transaction, Version

_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
#: Items that may be selected for one bulk deletion.
MOST_SELECTED = 1000


# --- folders ------------------------------------------------------------------------------------------------------


def _slot(parent: Column, name: Column) -> Column:
    """What must be unique among folders: the parent and the name in lower case."""
    return F.struct(parent.alias("p"), F.lower(trimmed(name)).alias("n"))


def create_folders(folders: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(request_id, name, parent_id) with `reason`: 'name', 'parent' (missing), 'duplicate' (taken, or asked for earlier), null.

    The earliest request_id for a place is the one that gets it, if nothing else is wrong with it.
    """
    known = folders.select(F.col("id").alias("parent_id"), F.lit(True).alias("_parent"))
    taken = folders.select(_slot(F.col("parent_id"), F.col("name")).alias("_slot")).distinct().withColumn("_taken", F.lit(True))
    rows = requests.withColumn("_slot", _slot(F.col("parent_id"), F.col("name"))).join(known, "parent_id", "left")
    rows = rows.join(taken, rows["_slot"].eqNullSafe(taken["_slot"]), "left").drop(taken["_slot"])
    reason = F.when(detect.folder_name_reason(F.col("name")).isNotNull(), "name").when(F.col("parent_id").isNotNull() & F.col("_parent").isNull(), "parent").when(F.col("_taken"), "duplicate")
    rows = rows.withColumn("reason", reason)
    first = F.row_number().over(Window.partitionBy("_slot", F.col("reason").isNull()).orderBy("request_id"))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (first > 1), "duplicate").otherwise(F.col("reason")))
    return rows.select(*requests.columns, "reason")


def rename_folders(folders: DataFrame, renames: DataFrame) -> DataFrame:
    """renames(id, name) with `reason`: 'missing', 'name', 'duplicate' (another folder of the same parent has the name, or gets it), null.

    Of the renames of a batch to one place the least id gets it, and of several names for one folder the least stands.
    """
    own = folders.select("id", "parent_id", F.lit(True).alias("_there"))
    taken = folders.select(_slot(F.col("parent_id"), F.col("name")).alias("_s"), F.col("id").alias("_other"))
    rows = renames.join(own, "id", "left").withColumn("_slot", _slot(F.col("parent_id"), F.col("name")))
    met = rows.join(taken, rows["_slot"].eqNullSafe(taken["_s"]) & (F.col("id") != F.col("_other"))).select("id", "name").distinct().withColumn("_taken", F.lit(True))
    rows = rows.join(met, ["id", "name"], "left")
    reason = F.when(F.col("_there").isNull(), "missing").when(detect.folder_name_reason(F.col("name")).isNotNull(), "name").when(F.col("_taken"), "duplicate")
    rows = rows.select("id", "name", "_slot", reason.alias("reason"))
    good = F.col("reason").isNull()
    rows = rows.withColumn("_own", F.row_number().over(Window.partitionBy("id", good).orderBy("name")))
    rows = rows.withColumn("reason", F.when(good & (F.col("_own") > 1), "duplicate").otherwise(F.col("reason")))
    first = F.row_number().over(Window.partitionBy("_slot", F.col("reason").isNull()).orderBy("id"))
    return rows.select("id", "name", F.when(F.col("reason").isNull() & (first > 1), "duplicate").otherwise(F.col("reason")).alias("reason"))


def delete_folders(folders: DataFrame, documents: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(id) with `reason`: 'missing', 'not-empty' (subfolders or documents inside), null."""
    full = folders.select(F.col("parent_id").alias("id")).unionByName(documents.select(F.col("folder_id").alias("id"))).where("id IS NOT NULL").distinct()
    rows = ids.select("id").distinct().join(folders.select("id", F.lit(True).alias("_there")), "id", "left").join(full.withColumn("_full", F.lit(True)), "id", "left")
    return rows.select("id", F.when(F.col("_there").isNull(), "missing").when(F.col("_full"), "not-empty").alias("reason"))


# --- documents ----------------------------------------------------------------------------------------------------


def check_documents(requests: DataFrame) -> DataFrame:
    """requests(document_kind, folder_id, retry_of_job_id, ...) with the kind made plain (knowledge by default) and `reason`.

    reason: 'kind' (neither knowledge nor rule), 'folder' (rules lie in none), 'retry' (the job's id is no UUID), null.
    """
    kind = F.coalesce("document_kind", F.lit("knowledge"))
    reason = F.when(~kind.isin("knowledge", "rule"), "kind").when((kind == "rule") & F.col("folder_id").isNotNull(), "folder").when(~F.col("retry_of_job_id").rlike(_UUID), "retry")
    return requests.withColumn("reason", reason).withColumn("document_kind", F.when(kind.isin("knowledge", "rule"), kind))


def set_enabled(rows: DataFrame, toggles: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `enabled` as toggles(key, enabled) say, toggles of rows that do not exist). A null toggle is refused too.

    Where toggles of one key differ it is switched off.
    """
    good = toggles.where("enabled IS NOT NULL").groupBy(key).agg(F.min("enabled").alias("_enabled"))
    out = rows.join(good, key, "left").withColumn("enabled", F.coalesce("_enabled", "enabled")).drop("_enabled")
    return out, toggles.join(rows.select(key), key, "left_anti").unionByName(toggles.where("enabled IS NULL").join(rows.select(key), key, "left_semi"))


def home(tables: Mapping[str, DataFrame], owner_id) -> dict[str, DataFrame]:
    """The five tables of the first page, of one owner: documents, folders, jobs (newest first), connections, rule documents."""
    own = {name: repository.owned(rows, owner_id) for name, rows in tables.items()}
    documents = own["documents"].where("coalesce(deletion_status, 'active') = 'active'")
    return {
        "documents": documents.where("document_kind = 'knowledge'").orderBy(*repository.sort_documents(documents)),
        "folders": own["folders"].orderBy("sort_order", *repository.sort_folders()),
        "jobs": repository.stored_job(own["jobs"]).orderBy(F.col("created_at").desc(), F.col("job_id").desc()),
        "connections": repository.connections(own["grants"], own["client_permissions"]).orderBy("client_id"),
        "rule_documents": documents.where("document_kind = 'rule'").orderBy(*repository.sort_documents(documents)),
    }


def preview_highlights(chunks: DataFrame, documents: DataFrame, asked: DataFrame) -> DataFrame:
    """(chunk_id, document_id, source_spans, block_start, block_end) of asked(chunk_id), only where the chunk's version is the latest one."""
    live = documents.select("document_id", F.col("latest_version_id").alias("version_id"))
    rows = chunks.join(asked.select("chunk_id").distinct(), "chunk_id", "left_semi").join(live, ["document_id", "version_id"], "left_semi")
    return rows.select("chunk_id", "document_id", "source_spans", "block_start", "block_end")


def highlight_words(text: Column, spans: Column, mark: str = "chunk-range") -> Column:
    """The text as safe HTML with the words of spans(start_word, end_word) marked, one by one; words count from 0."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{SPACE}]+|[^{SPACE}]+"), 0)

    def shown(p: Column) -> Column:
        lead = F.get(p, 0).rlike(f"^[{SPACE}]").cast("int")  # pieces alternate; a blank may come first

        def one(x: Column, i: Column) -> Column:
            word = ((i - lead) / 2).cast("int")
            hit = ((i - lead) % 2 == 0) & F.exists(spans, lambda s: (word >= s["start_word"]) & (word < s["end_word"]))
            return F.when(hit, F.concat(F.lit(f'<mark class="{mark}">'), html_escape(x), F.lit("</mark>"))).otherwise(html_escape(x))

        return F.array_join(F.transform(p, one), "")

    return F.coalesce(F.get(F.transform(F.array(pieces), shown), 0), F.lit(""))


# --- cleanups and deletions ---------------------------------------------------------------------------------------


def complete_cleanups(jobs: DataFrame, documents: DataFrame, deletions: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, documents, refused) after done(job_id, document_id, deletion_job_id): claimed cleanups end, job and document go.

    refused(job_id, reason): 'claim' (the job is not a failed one whose cleanup has begun), 'deletion' (the document is not
    being deleted by that deletion job).
    """
    claim = jobs.where("status = 'failed' AND cleanup_started_at IS NOT NULL").select("job_id", "document_id", F.lit(True).alias("_claim"))
    leaving = documents.where("deletion_status = 'deleting'").select("document_id").join(deletions.select("document_id", "deletion_job_id"), "document_id").withColumn("_leaving", F.lit(True))
    rows = done.join(claim, ["job_id", "document_id"], "left").join(leaving, ["document_id", "deletion_job_id"], "left")
    rows = rows.withColumn("reason", F.when(F.col("_claim").isNull(), "claim").when(F.col("_leaving").isNull(), "deletion"))
    good = rows.where("reason IS NULL")
    return jobs.join(good.select("job_id"), "job_id", "left_anti"), documents.join(good.select("document_id"), "document_id", "left_anti"), rows.where("reason IS NOT NULL").select("job_id", "reason")


def fail_cleanups(jobs: DataFrame, failures: DataFrame, column: str = "cleanup_error") -> DataFrame:
    """jobs with the message of failures(job_id, message), cut to 500 characters, where a cleanup of a failed job has begun.

    Of several failures of a job the one whose message is least in order counts.
    """
    said = F.substring(F.coalesce(F.nullif(F.trim("message"), F.lit("")), F.lit("the cleanup failed")), 1, 500)
    rows = jobs.join(failures.groupBy("job_id").agg(F.min(said).alias("_said")), "job_id", "left")
    begun = (F.col("status") == "failed") & F.col("cleanup_started_at").isNotNull() & F.col("_said").isNotNull()
    return rows.withColumn(column, F.when(begun, F.col("_said")).otherwise(F.col(column))).drop("_said")


def settle_deletions(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Deletion jobs after a try, outcomes(document_id, error): a null error ends the job, any other keeps it for the next try.

    Of several outcomes of a document an error counts, the greatest in order.
    """
    tried = outcomes.groupBy("document_id").agg(F.struct(F.max("error").alias("error")).alias("_o"))
    rows = jobs.join(tried, "document_id", "left").where("_o IS NULL OR _o.error IS NOT NULL")
    failed = F.col("_o").isNotNull()
    rows = rows.withColumn("status", F.when(failed, "failed").otherwise(F.col("status"))).withColumn("attempts", F.col("attempts") + failed.cast("int"))
    return rows.withColumn("last_error", F.when(failed, F.substring("_o.error", 1, 500)).otherwise(F.col("last_error"))).drop("_o")


def bulk_delete(folders: DataFrame, documents: DataFrame, selected_folders: DataFrame, selected_documents: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(document outcomes, folders that go, kept): selected documents and all in selected folders are deleted, failed(document_id, message) apart.

    At most MOST_SELECTED items may be selected, all of them owned. Folders stay (kept) if any document inside failed.
    """
    from folioforge.operators.folders import deletion_targets

    if selected_folders.count() + selected_documents.count() > MOST_SELECTED:
        raise ValueError(f"at most {MOST_SELECTED} items may be selected")
    if not selected_documents.join(documents, "document_id", "left_anti").isEmpty():
        raise ValueError("a selected document does not exist")
    closure, inside, _ = deletion_targets(folders, documents, selected_folders)
    wanted = selected_documents.select("document_id").unionByName(inside.select("document_id")).distinct()
    outcomes = wanted.join(failed.select("document_id", "message"), "document_id", "left").withColumn("outcome", F.when(F.col("message").isNull(), "deleted").otherwise("failed"))
    kept = not inside.join(failed, "document_id", "left_semi").isEmpty()
    return outcomes, closure.limit(0) if kept else closure, kept


# --- failed ingestions --------------------------------------------------------------------------------------------


def fail_versions(versions: DataFrame, chunks: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, chunks) after failures(owner_id, version_id, message, final): no half of a failed version can be found.

    The chunks of a failed version go, whether or not it is tried again. Its status is 'failed' after a final failure, else
    'parsing', and `error_message` the message, cut to 500 characters. Of several failures of a version a final one counts.
    """
    last = failures.groupBy("owner_id", "version_id").agg(F.max(F.struct("final", "message")).alias("_f"))
    rows = versions.join(last, ["owner_id", "version_id"], "left")
    failed = F.col("_f").isNotNull()
    rows = rows.withColumn("status", F.when(failed, F.when(F.col("_f.final"), "failed").otherwise("parsing")).otherwise(F.col("status")))
    rows = rows.withColumn("error_message", F.when(failed, F.substring("_f.message", 1, 500)).otherwise(F.col("error_message")))
    return rows.select(*versions.columns), chunks.join(last, ["owner_id", "version_id"], "left_anti")


def commit_failures(home: Repository, failures: DataFrame) -> Version:
    """`fail_versions` on the tables document_versions and document_chunks of a repository, in one commit that writes only what changes."""

    def work(change: Transaction) -> None:
        named = failures.select("owner_id", "version_id").distinct()
        versions = change.parent.read("document_versions").join(named, ["owner_id", "version_id"], "left_semi")
        chunks = change.parent.read("document_chunks")
        change.upsert("document_versions", fail_versions(versions, chunks, failures)[0])
        change.delete("document_chunks", chunks.join(named, ["owner_id", "version_id"], "left_semi"))

    return home.change(work)


# --- rules --------------------------------------------------------------------------------------------------------


def scoped_bindings(bindings: DataFrame, rule_ids: DataFrame, documents: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """The bindings of rule_ids(rule_id) to documents in scope(document_id), on the current version of active documents only."""
    from folioforge.operators.search import latest_hits

    rows = bindings.join(rule_ids.select("rule_id").distinct(), "rule_id", "left_semi")
    if scope is not None:
        rows = rows.join(scope.select("document_id").distinct(), "document_id", "left_semi")
    return latest_hits(rows, documents)


def rule_sources(applied: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks that applied rules come from, in active documents of kind 'rule' only; else as `search.rule_evidence`."""
    from folioforge.operators.search import rule_evidence

    return rule_evidence(applied, chunks, documents.where("document_kind = 'rule'"))


def reach_warnings(rule_documents: DataFrame, rules_: DataFrame, bindings: DataFrame, links: DataFrame, stale: str, warning: str) -> DataFrame:
    """rule_documents with `extraction_warning` renewed where it is `stale` and extraction is ready.

    It is null if a rule of the document is bound itself or is linked to one that is, else `warning`.
    """
    both = links.select(F.col("left_rule_id").alias("rule_id"), F.col("right_rule_id").alias("via")).unionByName(links.select(F.col("right_rule_id").alias("rule_id"), F.col("left_rule_id").alias("via")))
    bound = bindings.select("rule_id").distinct()
    near = both.join(bound.withColumnRenamed("rule_id", "via"), "via", "left_semi").select("rule_id")
    reached = rules_.join(bound.unionByName(near).distinct(), "rule_id", "left_semi").select("rule_document_id").distinct().withColumn("_reached", F.lit(True))
    due = (F.col("extraction_status") == "ready") & (F.col("extraction_warning") == stale)
    fresh = F.when(F.col("_reached").isNull(), F.lit(warning))
    return rule_documents.join(reached, "rule_document_id", "left").withColumn("extraction_warning", F.when(due, fresh).otherwise(F.col("extraction_warning"))).drop("_reached")


def rebuild_counts(documents: DataFrame, rule_documents: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row (owners, nodes, links): what a rebuild of the whole graph has gone through."""
    live = documents.where("document_kind = 'knowledge' AND coalesce(deletion_status, 'active') = 'active' AND latest_version_id IS NOT NULL").select("owner_id")
    owners = live.unionByName(rule_documents.where("extraction_status = 'ready'").select("owner_id")).agg(F.count_distinct("owner_id").alias("owners"))
    return owners.crossJoin(nodes.agg(F.count(F.lit(1)).alias("nodes"))).crossJoin(links.agg(F.count(F.lit(1)).alias("links")))  # one row each


def rule_totals(rules_: DataFrame, reach: DataFrame) -> DataFrame:
    """(rule_document_id, rules, documents, reachable): rules, different documents and the sum of reach(rule_id, document_id) of each rule document."""
    rows = rules_.join(reach, "rule_id", "left")
    return rows.groupBy("rule_document_id").agg(F.count_distinct("rule_id").alias("rules"), F.count_distinct("document_id").alias("documents"), F.count("document_id").alias("reachable"))


def chunk_totals(listing: DataFrame, shown: Column) -> DataFrame:
    """One row (total, filtered): chunks of all listed documents and of those that are shown. listing has `chunks`."""
    n = F.size("chunks").cast("long")
    return listing.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(shown, n)), F.lit(0)).alias("filtered"))


def create_manual_rules(requests: DataFrame, owner_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new rows by table, refused) for requests(request_id, content): a document, its rule document, version and job each."""
    rows = requests.withColumn("m", detect.manual_rule(F.col("content")))
    made = lambda kind: stable_uuid(F.concat_ws(":", F.lit(kind), F.lit(owner_id), F.col("request_id").cast("string")))
    good = rows.where("m.reason IS NULL").select(
        made("document").alias("document_id"), made("version").alias("version_id"), made("job").alias("job_id"), F.lit(owner_id).alias("owner_id"), F.col("m.content").alias("content"),
        F.col("m.title").alias("title"), F.col("m.filename").alias("file_name"), F.octet_length("m.content").cast("long").alias("size_bytes"), F.lit("text/markdown").alias("mime_type"),
    )
    null = F.lit(None).cast("string")
    path = F.concat_ws("/", "owner_id", "document_id", "version_id", F.concat(F.col("version_id"), F.lit(".md")))
    return {
        "documents": good.select("document_id", "owner_id", F.lit("rule").alias("document_kind"), null.alias("folder_id"), "title", F.lit("markdown").alias("source_type")),
        "rule_documents": good.select("document_id", "owner_id", F.lit("manual").alias("source_mode"), F.col("content").alias("manual_content"), F.lit("processing").alias("extraction_status")),
        "document_versions": good.select("version_id", "document_id", "owner_id", path.alias("storage_path"), F.col("file_name").alias("original_filename"), "mime_type", "size_bytes", F.lit("uploaded").alias("status")),
        "document_ingestion_jobs": good.select("job_id", "owner_id", "document_id", "version_id", "file_name", "mime_type", "size_bytes", F.lit("uploading").alias("status"), F.lit("uploading").alias("stage"), F.lit(False).alias("original_available")),
    }, rows.where("m.reason IS NOT NULL").select("request_id", F.col("m.reason").alias("reason"))


@dataclass
class Processed:
    """What processing of rule documents leaves: the whole new tables, and one report row per document."""

    rules: DataFrame
    bindings: DataFrame
    links: DataFrame
    report: DataFrame


def process_rule_documents(
    chunks: DataFrame, existing: DataFrame, bound: DataFrame, linked: DataFrame, targets: DataFrame, *,
    embed: Callable[[DataFrame], DataFrame], provider: Callable[[list[dict]], list[dict]] | None = None, manual: DataFrame | None = None,
    keep_enabled: bool = False, settings=DEFAULTS,
) -> Processed:
    """Rule documents from chunks to rules, bindings and links, as tables that are to be committed together.

    chunks(document_id, ordinal, chunk_id, text) of the rule documents; existing(rule_id, rule_document_id, ordinal,
    statement, enabled, embedding), bound(rule_id, document_id, chunk_id, vector_score) and linked(left_rule_id,
    right_rule_id, vector_score) as stored; targets(chunk_id, document_id, embedding, text) to bind to, ids of rules and
    chunks being longs. embed(rows with rule_id, statement) adds `embedding`. The provider finds candidates, or
    manual(document_id, content) holds the one rule of each document, whose old toggle stays with keep_enabled.

    A document without a valid rule keeps what it had and is reported with 'no-rules'. The rules of the others replace
    their old ones; bindings and links of rules that went go too, and new rules link with all rules that stay.
    """
    documents = chunks.select("document_id").distinct()
    if manual is not None:
        found = rules.manual_rule(manual, chunks).withColumn("ordinal", F.lit(0)).withColumn("reason", F.lit(None).cast("string"))
    else:
        candidates = models.extract_rules(chunks, provider, settings)
        found = rules.validate_candidates(candidates, chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text"), settings)
    from folioforge.session import stored

    found = stored(found.select("document_id", F.col("source_chunk_id").cast("string").alias("source_chunk_id"), "statement", F.col("ordinal").cast("int").alias("ordinal"), "reason"), "rule-candidates")
    good = found.where("reason IS NULL")
    old = existing.groupBy(F.col("rule_document_id").alias("document_id")).agg(F.min("enabled").alias("_was"), F.count(F.lit(1)).alias("_had"))
    enabled = F.when(F.lit(keep_enabled) & (F.col("_had") == 1), F.col("_was")).otherwise(F.lit(True))
    rule_id = F.xxhash64(F.lit("rule"), "document_id", "ordinal", "statement")
    fresh = good.join(old, "document_id", "left").select(rule_id.alias("rule_id"), F.col("document_id").alias("rule_document_id"), "ordinal", "statement", "source_chunk_id", enabled.alias("enabled"))
    fresh = stored(embed(fresh), "rule-vectors")
    replaced = fresh.select("rule_document_id").distinct()
    stay = existing.join(replaced, "rule_document_id", "left_anti")
    gone = existing.join(replaced, "rule_document_id", "left_semi").select("rule_id")
    every = stay.unionByName(fresh, allowMissingColumns=True)
    new_bindings = rules.bindings(fresh.select("rule_id", "embedding"), targets, settings=settings)
    all_bindings = bound.join(gone, "rule_id", "left_anti").unionByName(new_bindings.select(*bound.columns))
    kept_links = linked.join(gone.withColumnRenamed("rule_id", "left_rule_id"), "left_rule_id", "left_anti").join(gone.withColumnRenamed("rule_id", "right_rule_id"), "right_rule_id", "left_anti")
    ids = fresh.select("rule_id")
    near = rules.rule_links(every.select("rule_id", "embedding"), settings=settings)
    touch = near.join(ids.withColumnRenamed("rule_id", "left_rule_id"), "left_rule_id", "left_semi").unionByName(near.join(ids.withColumnRenamed("rule_id", "right_rule_id"), "right_rule_id", "left_semi")).distinct()
    all_links = kept_links.select(*linked.columns).unionByName(touch.select(*linked.columns))
    made = fresh.groupBy(F.col("rule_document_id").alias("document_id")).agg(F.count(F.lit(1)).alias("rules"))
    refused = found.where("reason IS NOT NULL").groupBy("document_id").agg(F.count(F.lit(1)).alias("refused"))
    report = documents.join(made, "document_id", "left").join(refused, "document_id", "left")
    report = report.select("document_id", F.when(F.col("rules").isNull(), "no-rules").alias("problem"), F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("refused", F.lit(0)).alias("refused"))
    return Processed(every, all_bindings, all_links, report)


def commit_rule_documents(home: Repository, chunks: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """`process_rule_documents` on the tables rules, bindings and links of a repository; the report.

    The three change in one commit, in which only rows that differ are written. Another writer's commit makes it start again
    from what that one left.
    """
    reports: list[DataFrame] = []

    def work(change: Transaction) -> None:
        now = {name: change.parent.read(name) for name in ("rules", "bindings", "links")}
        got = process_rule_documents(chunks, now["rules"], now["bindings"], now["links"], targets, **options)
        for name, rows in (("rules", got.rules), ("bindings", got.bindings), ("links", got.links)):
            names = now[name].columns
            change.become(name, rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in names]))
        reports[:] = [got.report]

    home.change(work)
    return reports[0]
