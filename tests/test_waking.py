"""Jobs on a stream with late events, leases that lapse, retries that come due, and restarts from the checkpoint."""

from folioforge.streaming import jobs

SCHEMA = "job_id string, at timestamp, seq int, kind string, token string, error string, retryable boolean"
BATCHES = [
    [("a", "10:00:00", 1, "claim", "t", None, None), ("b", "10:00:05", 1, "claim", "t", None, None), ("c", "10:00:00", 1, "claim", "t", None, None), ("c", "10:02:00", 3, "ready", "t", None, None)],
    # The stage of c is late, and comes before what is folded; the failure of b may be retried.
    [("b", "10:01:00", 2, "failure", "t", "busy", True), ("c", "10:01:00", 2, "stage", "t", "chunking", None), ("z", "10:20:00", 1, "claim", "t", None, None)],
    [("a", "10:25:00", 2, "claim", "u", None, None), ("a", "10:26:00", 3, "claim", "t", None, None), ("b", "10:27:00", 3, "claim", "t", None, None), ("b", "10:27:30", 4, "ready", "t", None, None), ("a", "09:00:00", 0, "failure", "t", "far too late", False)],
    [("z", "12:00:00", 2, "stage", "t", "indexing", None)],
]


def test_a_stream_with_timers(spark, tmp_path):
    kept, log = [], []
    for i, batch in enumerate(BATCHES):
        rows = [(j, f"2024-05-01 {at}", *rest) for j, at, *rest in batch]
        log += rows
        spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).selectExpr("job_id", "to_timestamp(at) AS at", "seq", "kind", "token", "error", "retryable").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        found = jobs.waking_jobs(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")))
        run = found.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()  # each round is a restart
        assert run.awaitTermination(120), i
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("*", "date_format(at, 'HH:mm:ss') AS t").orderBy("job_id", "at").collect()
    wakes = [(r.job_id, r.t, r.wake) for r in got if r.wake]
    assert wakes == [("a", "10:05:00", "lease"), ("a", "10:31:00", "lease"), ("b", "10:02:00", "retry"), ("z", "10:25:00", "lease")]
    last = {r.job_id: r for r in got if not r.wake}
    used = [e for e in log if "too late" not in (e[5] or "") and not (e[0] == "z" and e[2] == 2)]
    batch = spark.createDataFrame([(j, s, k, t, e, r) for j, _, s, k, t, e, r in used], "job_id string, seq int, kind string, token string, error string, retryable boolean")
    for r in jobs.replay(batch).collect():
        assert tuple(last[r.job_id][n] for n in jobs.FIRST) == tuple(r[n] for n in jobs.FIRST), r.job_id
    assert last["c"].status == "ready" and last["c"].refused == 0  # in order of time, although the stage came a batch later
    kept.append(last)


def test_folding_does_not_depend_on_the_cuts():
    events = [{"at": k * 1000 * 50, "seq": k, "kind": kind, "token": "t", "error": "chunking" if kind == "stage" else None, "retryable": True} for k, kind in enumerate(["claim", "stage", "failure", "claim", "stage", "stage", "failure", "ready"])]
    whole = jobs.folded(dict(jobs.FIRST), [], events, 10**9, 60, 30)
    s, due, rows = dict(jobs.FIRST), [], []
    for k in range(9):
        mark = k * 50_000 + 20_000
        s, due, more = jobs.folded(s, due, [e for e in events if e["at"] == k * 50_000], mark, 60, 30)
        rows += more
    s, due, more = jobs.folded(s, due, [], 10**9, 60, 30)
    rows += more
    assert (s, due) == whole[:2] and [r[:2] for r in rows if r[1]] == [r[:2] for r in whole[2] if r[1]]
