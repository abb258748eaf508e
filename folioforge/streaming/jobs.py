"""Job state machines as folds over ordered events, in batch and on a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.repository import JOB_STAGES

_STATE = "struct<status:string,stage:string,attempts:int,token:string,original_available:boolean,last_error:string,refused:int>"
#: Seconds that a cleanup may hold its lease.
LEASE = 300


def _state(**values: Column) -> Column:
    names = ("status", "stage", "attempts", "token", "original_available", "last_error", "refused")
    return F.struct(*[values[n].alias(n) for n in names]).cast(_STATE)


def step(s: Column, e: Column) -> Column:
    """The state after an event(kind, token, error, retryable).

    claim: from uploading, from failed with the original there, or again with the token that holds the job;
    it counts an attempt if the job failed before or is being processed. stage: only forward. ready and failure
    need the token. A failure that may be retried leaves the job in processing; a final one fails it. Anything
    else is refused and leaves the state as it is.
    """
    holds = s["token"].eqNullSafe(e["token"])
    may_claim = (s["status"] == "uploading") | ((s["status"] == "failed") & s["original_available"]) | ((s["status"] == "processing") & holds)
    counted = F.when(s["status"].isin("failed", "processing"), s["attempts"] + 1).otherwise(s["attempts"])
    put = lambda **v: _state(**({n: s[n] for n in ("status", "stage", "attempts", "token", "original_available", "last_error", "refused")} | v))
    null = F.lit(None).cast("string")
    places = F.array(*[F.lit(x) for x in JOB_STAGES])
    forward = F.array_position(places, e["error"]) >= F.array_position(places, s["stage"])
    busy = (s["status"] == "processing") & holds
    return (
        F.when((e["kind"] == "claim") & may_claim, put(status=F.lit("processing"), stage=F.lit("parsing"), attempts=counted, token=e["token"], last_error=null))
        .when((e["kind"] == "stage") & busy & F.coalesce(forward, F.lit(False)), put(stage=e["error"]))
        .when((e["kind"] == "ready") & busy, put(status=F.lit("ready"), stage=F.lit("ready"), last_error=null))
        .when((e["kind"] == "failure") & busy & e["retryable"], put(last_error=F.substring(e["error"], 1, 500)))
        .when((e["kind"] == "failure") & busy, put(status=F.lit("failed"), stage=F.lit("failed"), last_error=F.substring(e["error"], 1, 500)))
        .when((e["kind"] == "upload-failed") & (s["status"] == "uploading"), put(status=F.lit("failed"), stage=F.lit("failed"), original_available=F.lit(False)))
        .when((e["kind"] == "reupload") & (s["status"] == "failed") & ~s["original_available"], put(status=F.lit("uploading"), stage=F.lit("uploading"), attempts=s["attempts"] + 1, token=null, original_available=F.lit(True), last_error=null))
        .otherwise(put(refused=s["refused"] + 1))
    )


def start() -> Column:
    return _state(status=F.lit("uploading"), stage=F.lit("uploading"), attempts=F.lit(1), token=F.lit(None), original_available=F.lit(True), last_error=F.lit(None), refused=F.lit(0))


def replay(events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """(key, status, stage, attempts, token, original_available, last_error, refused) after all events of each job, in order.

    events(key, order, kind, token, error, retryable). A job's own log is one array; jobs are spread by key.
    """
    item = F.struct(order, "kind", F.col("token").cast("string").alias("token"), F.col("error").cast("string").alias("error"), F.coalesce(F.col("retryable").cast("boolean"), F.lit(False)).alias("retryable"))
    per = events.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("es"))
    return per.select(key, F.aggregate("es", start(), step).alias("s")).select(key, "s.*")


# --- the same machine on a stream -------------------------------------------------------------------------------


def advance(s: dict, kind: str, token: str | None, error: str | None, retryable: bool) -> dict:
    """One event in plain Python, as `step` has it in SQL."""
    holds, busy = s["token"] == token, s["status"] == "processing" and s["token"] == token
    if kind == "claim" and (s["status"] == "uploading" or (s["status"] == "failed" and s["original_available"]) or busy):
        return s | {"status": "processing", "stage": "parsing", "attempts": s["attempts"] + (s["status"] != "uploading"), "token": token, "last_error": None}
    if kind == "stage" and busy and holds and error in JOB_STAGES and JOB_STAGES.index(error) >= JOB_STAGES.index(s["stage"]):
        return s | {"stage": error}
    if kind == "ready" and busy:
        return s | {"status": "ready", "stage": "ready", "last_error": None}
    if kind == "failure" and busy:
        return s | {"last_error": None if error is None else error[:500]} | ({} if retryable else {"status": "failed", "stage": "failed"})
    if kind == "upload-failed" and s["status"] == "uploading":
        return s | {"status": "failed", "stage": "failed", "original_available": False}
    if kind == "reupload" and s["status"] == "failed" and not s["original_available"]:
        return s | {"status": "uploading", "stage": "uploading", "attempts": s["attempts"] + 1, "token": None, "original_available": True, "last_error": None}
    return s | {"refused": s["refused"] + 1}


FIRST = {"status": "uploading", "stage": "uploading", "attempts": 1, "token": None, "original_available": True, "last_error": None, "refused": 0}
_FIELDS = "status string, stage string, attempts int, token string, original_available boolean, last_error string, refused int"


def stream_jobs(events: DataFrame) -> DataFrame:
    """A stream of events(job_id string, seq, kind, token, error, retryable) -> the state of each job that changed, per batch."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names = list(FIRST)
        s = dict(zip(names, state.get, strict=True)) if state.exists else dict(FIRST)
        rows = pd.concat(list(frames)).sort_values("seq")
        none = lambda x: None if x is None or x != x else x
        for e in rows.itertuples():
            s = advance(s, e.kind, none(e.token), none(e.error), bool(none(e.retryable)))
        state.update(tuple(s[n] for n in names))
        yield pd.DataFrame([{"job_id": key[0]} | s])

    return events.groupBy("job_id").applyInPandasWithState(run, f"job_id string, {_FIELDS}", _FIELDS, "update", "NoTimeout")


#: Seconds after which a failure that may be retried is due again.
RETRY = 60


def folded(s: dict, due: list, events: list[dict], mark: int, lease: int, retry: int) -> tuple[dict, list, list[tuple]]:
    """(state, [when, what] that is due, rows (at, wake, state)) after events in order of their time, up to `mark` (milliseconds).

    A claim or a new stage holds the job for `lease` seconds, a failure that may be retried is due after `retry`; what
    passes its time without another event wakes the job: 'lease' or 'retry'. Everything else that is accepted ends the waiting.
    """
    rows, at = [], None
    for e in [*sorted(events, key=lambda e: (e["at"], e["seq"])), None]:
        if due and due[0] <= (mark if e is None else e["at"]):
            rows.append((due[0], due[1], s))
            due = []
        if e is None:
            break
        after = advance(s, e["kind"], e["token"], e["error"], e["retryable"])
        if after["refused"] == s["refused"]:
            due = [e["at"] + 1000 * lease, "lease"] if e["kind"] in ("claim", "stage") else [e["at"] + 1000 * retry, "retry"] if e["kind"] == "failure" and e["retryable"] else []
        s, at = after, e["at"]
    return s, due, rows if at is None else [*rows, (at, None, s)]


def waking_jobs(events: DataFrame, late: str = "10 minutes", lease: int = LEASE, retry: int = RETRY) -> DataFrame:
    """A stream of events(job_id string, at timestamp, seq, kind, token, error, retryable) -> (job_id, at, wake, state) to append.

    Events wait until no earlier one can come (the watermark, `late` behind the newest), then they are folded in order of time and
    seq, whatever batch brought them; what comes later still is left out. A row without `wake` is the state after the events so far. A
    row with it says that a lease has lapsed or a retry is due, and comes from a timer, without any event. Waiting events, states and
    timers are kept in the stream's checkpoint.
    """
    names = list(FIRST)
    none = lambda x: None if x is None or x != x else x

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s, due, waiting = dict(FIRST), [], []
        if state.exists:
            *values, held = state.get
            s = dict(zip(names, values, strict=True))
            due, waiting = json.loads(held)
        for frame in frames:
            for e in frame.itertuples():
                waiting.append({"at": int(e.at.value // 1_000_000), "seq": int(e.seq), "kind": e.kind, "token": none(e.token), "error": none(e.error), "retryable": bool(none(e.retryable))})
        mark = state.getCurrentWatermarkMs()
        s, due, rows = folded(s, due, [e for e in waiting if e["at"] <= mark], mark, lease, retry)
        waiting = [e for e in waiting if e["at"] > mark]
        state.update((*(s[n] for n in names), json.dumps([due, waiting])))
        wake = min([*due[:1], *(e["at"] for e in waiting)], default=None)
        if wake is not None:
            state.setTimeoutTimestamp(max(wake, mark + 1))
        yield pd.DataFrame([{"job_id": key[0], "at": pd.Timestamp(at, unit="ms"), "wake": what} | of for at, what, of in rows], columns=["job_id", "at", "wake", *names])

    return events.withWatermark("at", late).groupBy("job_id").applyInPandasWithState(run, f"job_id string, at timestamp, wake string, {_FIELDS}", f"{_FIELDS}, held string", "append", "EventTimeTimeout")


# --- cleanup leases, deletions, backfill -----------------------------------------------------------------------


def claim_cleanups(jobs: DataFrame, now: Column, seconds: int = LEASE) -> DataFrame:
    """Failed jobs whose cleanup may start: not begun, or begun longer ago than the lease."""
    free = F.col("cleanup_started_at").isNull() | (F.unix_seconds(now) - F.unix_seconds("cleanup_started_at") > seconds)
    return jobs.withColumn("claimed", (F.col("status") == "failed") & free).withColumn("cleanup_started_at", F.when(F.col("claimed"), now).otherwise(F.col("cleanup_started_at")))


def request_deletion(documents: DataFrame, versions: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, jobs): requested documents are hidden; one job each with all storage paths, oldest first."""
    hit = requested.select("document_id").distinct().withColumn("_d", F.lit(True))
    hidden = documents.join(hit, "document_id", "left").withColumn("deletion_status", F.when(F.col("_d"), "deleting").otherwise(F.col("deletion_status"))).drop("_d")
    paths = versions.join(hit, "document_id", "left_semi").groupBy("document_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("created_at", "storage_path"))), lambda x: x["storage_path"]).alias("storage_paths"),
        F.coalesce(F.bool_or(F.col("status").isin("indexing", "ready", "failed")), F.lit(False)).alias("requires_vector_cleanup"),
    )
    jobs = documents.join(hit, "document_id", "left_semi").select("document_id", "owner_id").join(paths, "document_id", "left")
    jobs = jobs.withColumn("storage_paths", F.coalesce("storage_paths", F.array().cast("array<string>"))).withColumn("requires_vector_cleanup", F.coalesce("requires_vector_cleanup", F.lit(False)))
    return hidden, jobs.withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))


def complete_deletion(rows: DataFrame, done: DataFrame, key: str = "document_id") -> DataFrame:
    """The rows that stay once deletions are done."""
    return rows.join(done.select(key), key, "left_anti")


def bulk_delete(selected: DataFrame, owned: DataFrame, failed: DataFrame) -> DataFrame:
    """(document_id, outcome) for each selected id: deleted, failed or missing."""
    rows = selected.select("document_id").distinct().join(owned.select("document_id").withColumn("_o", F.lit(True)), "document_id", "left").join(failed.select("document_id").distinct().withColumn("_f", F.lit(True)), "document_id", "left")
    return rows.select("document_id", F.when(F.col("_o").isNull(), "missing").when(F.col("_f"), "failed").otherwise("deleted").alias("outcome"))


def reindex_plan(documents: DataFrame, chunks: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points to delete, chunks to store) when the index is made anew from the current versions of active knowledge documents."""
    live = documents.where("document_kind = 'knowledge' AND coalesce(deletion_status, 'active') = 'active' AND latest_version_id IS NOT NULL")
    current = chunks.join(live.select("document_id", F.col("latest_version_id").alias("version_id")), ["document_id", "version_id"], "left_semi")
    return points.join(live.select("document_id"), "document_id", "left_semi"), current


def renamed(documents: DataFrame, chunks: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) after names(document_id, new_title): titles and the text by which chunks are indexed."""
    from folioforge.functions.text import text_for_index

    to = names.select("document_id", "new_title")
    docs = documents.join(to, "document_id", "left").withColumn("title", F.coalesce("new_title", "title")).drop("new_title")
    rows = chunks.drop("title").join(docs.select("document_id", "title"), "document_id")
    return docs, rows.withColumn("sparse_text", text_for_index(F.col("title"), F.col("heading_path"), F.col("text")))


def revise_rules(rule_documents: DataFrame, jobs: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule documents after revisions(rule_document_id, content), refused revisions): none while a job of the document runs."""
    busy = jobs.where(~F.col("status").isin("ready", "failed")).select(F.col("document_id").alias("rule_document_id")).distinct()
    good = revisions.join(busy, "rule_document_id", "left_anti").select("rule_document_id", F.struct("content").alias("_new"))
    rows = rule_documents.join(good, "rule_document_id", "left")
    rows = rows.withColumn("manual_content", F.coalesce("_new.content", "manual_content")).withColumn("extraction_status", F.when(F.col("_new").isNotNull(), "pending").otherwise(F.col("extraction_status"))).drop("_new")
    return rows, revisions.join(busy, "rule_document_id", "left_semi")


def backfill_jobs(versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs for versions that have none, in the state that the version shows."""
    s = F.col("status")
    rows = versions.join(jobs.select("version_id"), "version_id", "left_anti")
    job = F.when(s == "ready", "ready").when(s == "failed", "failed").otherwise("processing")
    stage = F.when(s == "ready", "ready").when(s == "failed", "failed").when(s == "indexing", "indexing").otherwise("parsing")
    return rows.select("version_id", "document_id", "owner_id", job.alias("status"), stage.alias("stage"), F.lit(1).alias("attempts"))
