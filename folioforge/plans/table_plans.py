"""Repository queries over the business tables: versions, listings, orders, pages, jobs, folders, stores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.functions import text as T
from folioforge.operators import folders, repository, rules, search
from folioforge.plans.common import query
from folioforge.session import shared_dir, table
from folioforge.sources import store
from folioforge.sources.commits import Repository
from folioforge.streaming import jobs, progress


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"), "o_orderdate", "o_orderstatus", "o_totalprice")


@query("""
SELECT o_custkey AS document_id, o_orderkey AS version_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.latest_versions(_orders(spark, sf_dir), "document_id", ["o_orderdate", "version_id"]).select("document_id", "version_id")


@query("""
WITH latest AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY o_custkey)
SELECT o_orderkey AS version_id, o_custkey AS document_id, o_totalprice AS score FROM orders JOIN latest USING (o_custkey) WHERE o_orderkey = v AND o_totalprice >= 100000""")
def latest_hits_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    docs = o.groupBy("document_id").agg(F.max_by("version_id", F.struct("o_orderdate", "version_id")).alias("latest_version_id"))
    hits = o.where("o_totalprice >= 100000").select("version_id", "document_id", F.col("o_totalprice").alias("score"))
    return search.latest_hits(hits, docs).select("version_id", "document_id", "score")


@query("""
WITH latest AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY o_custkey),
lines AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS lo FROM lineitem GROUP BY l_orderkey)
SELECT o_custkey AS document_id, v AS version_id, o_orderstatus AS status, coalesce(n, 0) AS n_chunks, coalesce(lo, -1) AS first_ordinal
FROM latest JOIN orders USING (o_custkey) LEFT JOIN lines ON l_orderkey = v WHERE o_orderkey = v""")
def doc_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    docs = o.groupBy("document_id").agg(F.max_by("version_id", F.struct("o_orderdate", "version_id")).alias("latest_version_id"))
    versions = o.select("version_id", F.col("o_orderstatus").alias("status"), F.lit("f").alias("original_filename"), F.lit(0).alias("size_bytes"))
    li = table(spark, sf_dir, "lineitem")
    chunks = li.select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("ordinal"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_returnflag").alias("text"))
    got = repository.indexed_documents(docs, versions, chunks)
    return got.select("document_id", F.col("latest_version_id").alias("version_id"), "status", F.size("chunks").cast("long").alias("n_chunks"), F.coalesce(F.get("chunks", F.lit(0))["ordinal"], F.lit(-1)).alias("first_ordinal"))


_KEY = r"array_to_string(list_transform(regexp_extract_all(lower(t), '(\d+|\D+)'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(p, 20, '0') ELSE p END), '')"


@query(f"SELECT p_partkey, title FROM (SELECT p_partkey, t AS title, {_KEY} AS k FROM (SELECT p_partkey, p_name || ' ' || p_size AS t FROM part)) ORDER BY k, p_partkey LIMIT 50")
def doc_sort_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.concat_ws(" ", "p_name", "p_size").alias("title"))
    return p.orderBy(*repository.sort_documents(p, "name")).limit(50).select(F.col("document_id").alias("p_partkey"), "title")


@query("SELECT o_orderkey AS document_id, o_orderdate AS indexed_at FROM orders ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey LIMIT 30")
def doc_sort_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("indexed_at"), F.col("o_orderpriority").alias("title"))
    return o.orderBy(*repository.sort_documents(o, "recent")).limit(30).select("document_id", "indexed_at")


@query(f"SELECT p_partkey AS document_id, row_number() OVER (ORDER BY k, p_partkey) AS position FROM (SELECT p_partkey, {_KEY} AS k FROM (SELECT p_partkey, p_name || ' ' || p_size AS t FROM part))")
def doc_order_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole order of which doc_sort_natural shows the beginning."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.concat_ws(" ", "p_name", "p_size").alias("title"))
    return repository.positions(p, repository.sort_documents(p, "name"))


@query("SELECT o_orderkey AS document_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) AS position FROM orders")
def doc_order_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole order of which doc_sort_recent shows the beginning."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("indexed_at"), F.col("o_orderpriority").alias("title"))
    return repository.positions(o, repository.sort_documents(o, "recent"))


@query("SELECT o_orderkey AS job_id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30 OFFSET 60")
def job_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return repository.page(o, [F.col("o_orderdate").desc(), F.col("job_id").desc()], 3, 30).select("job_id", "status")


_STATUS = {"signup": "uploading", "click": "queued", "view": "processing", "purchase": "ready", "error": "failed"}
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.lit(None).cast("string")
    for k, v in _STATUS.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    return e.withColumn("status", status)


@query("""
SELECT user_id, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS running, count(*) FILTER (event_type = 'purchase') AS ready, count(*) FILTER (event_type = 'error') AS failed
FROM events GROUP BY user_id""")
def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.job_counts(_events(spark, sf_dir), "user_id")


@query(f"SELECT user_id, arg_max({_STATUS_SQL}, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("stage", F.lit("parsing"))
    return repository.stored_job(repository.latest_versions(e, "user_id", ["ts", "event_id"])).select("user_id", "status", "event_id")


_KINDS = {"signup": "reupload", "click": "claim", "view": "stage", "purchase": "ready", "error": "failure"}


_STAGE_LIST = "[" + ", ".join(f"'{x}'" for x in repository.JOB_STAGES) + "]"


@query(f"""
WITH RECURSIVE ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS kind,
  (event_id % 2)::VARCHAR AS token, CASE WHEN event_type = 'view' THEN 'chunking' ELSE props END AS error, coalesce(value > 10, false) AS retryable FROM events),
run AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'uploading' AS status, 'uploading' AS stage, 1 AS attempts, NULL::VARCHAR AS token, true AS original_available, NULL::VARCHAR AS last_error, 0 AS refused FROM events
  UNION ALL SELECT user_id, n, CASE act WHEN 'claim' THEN 'processing' WHEN 'ready' THEN 'ready' WHEN 'fail' THEN 'failed' ELSE status END, CASE act WHEN 'claim' THEN 'parsing' WHEN 'stage' THEN error WHEN 'ready' THEN 'ready' WHEN 'fail' THEN 'failed' ELSE stage END,
    attempts + CASE WHEN act = 'claim' AND status IN ('failed', 'processing') THEN 1 ELSE 0 END, CASE WHEN act = 'claim' THEN new_token ELSE token END, original_available,
    CASE WHEN act IN ('claim', 'ready') THEN NULL WHEN act IN ('retry', 'fail') THEN substr(error, 1, 500) ELSE last_error END, refused + CASE WHEN act = 'refuse' THEN 1 ELSE 0 END
  FROM (SELECT r.*, e.n AS m, e.token AS new_token, e.error, CASE
      WHEN e.kind = 'claim' AND (r.status = 'uploading' OR (r.status = 'failed' AND r.original_available) OR (r.status = 'processing' AND r.token IS NOT DISTINCT FROM e.token)) THEN 'claim'
      WHEN r.status = 'processing' AND r.token IS NOT DISTINCT FROM e.token THEN CASE WHEN e.kind = 'stage' AND list_position({_STAGE_LIST}, e.error) >= list_position({_STAGE_LIST}, r.stage) THEN 'stage' WHEN e.kind = 'ready' THEN 'ready'
        WHEN e.kind = 'failure' THEN CASE WHEN e.retryable THEN 'retry' ELSE 'fail' END ELSE 'refuse' END ELSE 'refuse' END AS act
    FROM (SELECT user_id, n + 1 AS n, status, stage, attempts, token, original_available, last_error, refused FROM run) r JOIN ev e ON e.user_id = r.user_id AND e.n = r.n))
SELECT user_id AS job_id, status, stage, attempts, token, original_available, last_error, refused FROM run WHERE (user_id, n) IN (SELECT user_id, max(n) FROM ev GROUP BY user_id)""")
def job_claim_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.lit(None).cast("string")
    for k, v in _KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    log = e.select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 2).cast("string").alias("token"), F.when(F.col("event_type") == "view", "chunking").otherwise(F.col("props")).alias("error"), (F.col("value") > 10).alias("retryable"))
    return jobs.replay(log)


_PLACE = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END"


@query(f"""
SELECT user_id, count(*) FILTER (fwd) AS forward, count(*) FILTER (NOT fwd) AS backward FROM (
  SELECT user_id, p >= coalesce(max(p) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fwd FROM (SELECT *, {_PLACE} AS p FROM events)) GROUP BY user_id""")
def stage_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("n"), F.col("event_type").alias("stage"))
    got = progress.forward_only(e, "user_id", "n", ("signup", "view", "click", "purchase", "error"))
    return got.groupBy("user_id").agg(F.count_if("forward").alias("forward"), F.count_if(~F.col("forward")).alias("backward"))


@query("""
SELECT user_id, count(*) FILTER (event_type IN ('signup', 'view', 'click')) AS progress, count(*) FILTER (event_type = 'purchase') AS results, count(*) FILTER (event_type = 'error') AS invalid FROM events GROUP BY user_id""")
def progress_ndjson_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit('{"type":"result","result":'), F.col("props"), F.lit("}")))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"type":"progress","stage":"unknown","at":'), F.col("event_id").cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"type":"progress","stage":"ranking","at":'), F.col("event_id").cast("string"), F.lit("}")))
    )
    whole = e.select("user_id", "event_id", F.concat(line, F.lit("\n")).alias("l"))
    cut = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.substring("l", 1, 9).alias("t")), F.struct(F.lit(1).alias("k"), F.expr("substring(l, 10)").alias("t"))))
    pieces = whole.select("user_id", "event_id", cut.alias("c")).select("user_id", F.struct("event_id", "c.k").alias("seq"), F.col("c.t").alias("fragment"))
    got = progress.parse_fragments(pieces, "user_id")
    return got.groupBy("user_id").agg(F.count_if(F.col("valid") & (F.col("type") == "progress")).alias("progress"), F.count_if(F.col("valid") & (F.col("type") == "result")).alias("results"), F.count_if(~F.col("valid")).alias("invalid"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%GE_r%' OR lower(p_name || ' ' || p_brand) LIKE '%brand#2%'")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("original_filename"))
    both = repository.titles_like(p, "GE_r").unionByName(repository.search_titles(p, "Brand#2")).distinct()
    return both.select("p_partkey", F.col("title").alias("p_name"))


# --- folders: regions above nations above suppliers, ten of them below each; customers and suppliers are the documents ---

_FOLDERS = """
folders AS (SELECT 'R' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation
UNION ALL SELECT 'F' || s_suppkey, CASE WHEN s_suppkey < 10 THEN 'N' || s_nationkey ELSE 'F' || s_suppkey // 10 END, s_name FROM supplier)"""


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = r.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), F.lit(0).alias("sort_order"))
    under = n.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"), F.lit(0).alias("sort_order"))
    parent = F.when(F.col("s_suppkey") < 10, F.concat(F.lit("N"), "s_nationkey")).otherwise(F.concat(F.lit("F"), F.floor(F.col("s_suppkey") / 10)))
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("F"), "s_suppkey").alias("id"), parent.alias("parent_id"), F.col("s_name").alias("name"), F.lit(0).alias("sort_order"))
    return top.unionByName(under).unionByName(own)


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    a = c.select(F.concat(F.lit("C"), "c_custkey").alias("document_id"), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("N"), "c_nationkey")).alias("folder_id"))
    return a.unionByName(s.select(F.concat(F.lit("S"), "s_suppkey").alias("document_id"), F.concat(F.lit("N"), "s_nationkey").alias("folder_id")))


_FILED = """
filed AS (SELECT 'C' || c_custkey AS document_id, CASE WHEN c_acctbal >= 0 THEN 'N' || c_nationkey END AS folder_id FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier)"""
_TREE = f"WITH RECURSIVE {_FOLDERS.strip()}, {_FILED.strip()}, up AS (SELECT id, id AS ancestor, 0 AS d FROM folders UNION ALL SELECT up.id, f.parent_id, d + 1 FROM up JOIN folders f ON f.id = up.ancestor WHERE f.parent_id IS NOT NULL)"


@query(f"{_TREE} SELECT ancestor AS root, id FROM up")
def folder_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.ancestors(_folders(spark, sf_dir)).select(F.col("ancestor").alias("root"), "id")


@query(f"""WITH RECURSIVE {_FOLDERS.strip()}, moved AS (SELECT id, CASE WHEN id = 'F3' THEN 'R4' ELSE parent_id END AS parent_id FROM folders),
up AS (SELECT id, id AS ancestor, 0 AS d FROM moved UNION ALL SELECT up.id, f.parent_id, d + 1 FROM up JOIN moved f ON f.id = up.ancestor WHERE f.parent_id IS NOT NULL) SELECT id, ancestor, d::BIGINT AS distance FROM up""")
def folder_closure_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of all folders, stored, after one tree moved: only the rows of that tree are made anew."""
    home, now = Repository(spark, f"{shared_dir(spark)}/closure-{uuid.uuid4().hex}"), _folders(spark, sf_dir)
    with home.begin() as change:
        change.create("folder_closure", StructType.fromDDL("id string, ancestor string, distance int"), ["id", "ancestor"])
        change.rewrite("folder_closure", folders.ancestors(now))
    moved = folders.move(now, spark.range(1).select(F.lit("F3").alias("id"), F.lit("R4").alias("target")), "parent_id")
    version = folders.commit_closure(home, moved, moved.where("id = 'F3'"))
    return version.read("folder_closure").select("id", "ancestor", F.col("distance").cast("long").alias("distance"))


@query(f"{_TREE} SELECT up.id, max(d)::BIGINT AS depth, string_agg(f.name, '/' ORDER BY d DESC) AS path FROM up JOIN folders f ON f.id = up.ancestor GROUP BY up.id")
def folder_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.folder_paths(_folders(spark, sf_dir)).select("id", F.col("depth").cast("long").alias("depth"), F.array_join("names", "/").alias("path"))


@query(f"""{_TREE}, p AS (SELECT up.id, max(d) AS depth, string_agg({_KEY.replace('lower(t)', 'lower(f.name)')} || '|' || f.id, '/' ORDER BY d DESC) AS way FROM up JOIN folders f ON f.id = up.ancestor GROUP BY up.id)
SELECT row_number() OVER (ORDER BY way) - 1 AS position, id, depth::BIGINT AS depth FROM p""")
def folder_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.flatten(_folders(spark, sf_dir)).select(F.col("position").cast("long").alias("position"), "id", F.col("depth").cast("long").alias("depth"))


@query(f"""WITH {_FOLDERS.strip()}, {_FILED.strip()} SELECT coalesce(k, 'top') AS folder_id, sum(f)::BIGINT AS folders, sum(d)::BIGINT AS documents FROM (
  SELECT parent_id AS k, 1 AS f, 0 AS d FROM folders UNION ALL SELECT folder_id, 0, 1 FROM filed) GROUP BY 1""")
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = folders.content_counts(_folders(spark, sf_dir), _filed(spark, sf_dir))
    return got.select(F.coalesce("folder_id", F.lit("top")).alias("folder_id"), "folders", "documents")


@query(f"{_TREE} SELECT document_id FROM filed JOIN up ON up.id = folder_id WHERE ancestor = 'R2'")
def scope_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.search_scope(_filed(spark, sf_dir), _folders(spark, sf_dir), "R2")


#: Each supplier's folder to and from that of its number without the last two digits, its nation and its region.
_MOVES = """
other AS (SELECT 'F' || s_suppkey AS f, unnest(['F' || s_suppkey // 100, 'N' || s_nationkey, 'R' || n_regionkey, 'F' || s_suppkey]) AS o FROM supplier JOIN nation ON n_nationkey = s_nationkey),
moves AS (SELECT f AS id, o AS target FROM other UNION SELECT o, f FROM other)"""


@query(f"{_TREE}, {_MOVES.strip()} SELECT m.id, m.target, NOT EXISTS (SELECT 1 FROM up WHERE up.id = m.target AND up.ancestor = m.id) AS allowed FROM moves m")
def move_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    to = F.array(F.concat(F.lit("F"), F.floor(F.col("s_suppkey") / 100)), F.concat(F.lit("N"), "s_nationkey"), F.concat(F.lit("R"), "n_regionkey"), F.concat(F.lit("F"), "s_suppkey"))
    other = s.select(F.concat(F.lit("F"), "s_suppkey").alias("id"), F.explode(to).alias("target"))
    moves = other.unionByName(other.select(F.col("target").alias("id"), F.col("id").alias("target"))).distinct()
    return folders.can_move(_folders(spark, sf_dir), moves)


@query(f"""{_TREE}, sel AS (SELECT * FROM (VALUES ('R1'), ('N3'), ('N1'), ('N8')) v(id)), clo AS (SELECT DISTINCT up.id FROM up JOIN sel ON sel.id = ancestor)
SELECT 'folder' AS kind, id FROM clo UNION ALL SELECT 'document', document_id FROM filed WHERE folder_id IN (SELECT id FROM clo)
UNION ALL SELECT 'root', id FROM sel WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.id = sel.id AND d > 0 AND ancestor IN (SELECT id FROM sel))""")
def deletion_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("R1", "N3", "N1", "N8")])).alias("id"))
    f, d, r = folders.deletion_targets(_folders(spark, sf_dir), _filed(spark, sf_dir), chosen)
    return f.select(F.lit("folder").alias("kind"), "id").unionByName(d.select(F.lit("document").alias("kind"), F.col("document_id").alias("id"))).unionByName(r.select(F.lit("root").alias("kind"), "id"))


@query(r"""
WITH p AS (SELECT string_split('web/' || regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+', '/', 'g') || 'page', '/') AS p FROM pages),
d AS (SELECT DISTINCT p[1:k] AS d FROM (SELECT p, unnest(range(1, len(p))) AS k FROM p))
SELECT array_to_string(d, '/') AS path, d[-1] AS name, CASE WHEN len(d) > 1 THEN array_to_string(d[1:len(d) - 1], '/') ELSE '' END AS parent, len(d) AS depth FROM d""")
def folder_upload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("web/"), F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/+", "/"), F.lit("page"))
    got = folders.upload_plan(table(spark, sf_dir, "pages").select(path.alias("relative_path")))
    return got.select("path", "name", F.coalesce("parent", F.lit("")).alias("parent"), F.col("depth").cast("long").alias("depth"))


# --- stores and edges ------------------------------------------------------------------------------------------------


@query("""
WITH cur AS (SELECT o_custkey AS id, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), inc AS (SELECT o_custkey AS id, arg_max(o_orderkey, o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT id, v FROM inc UNION ALL SELECT id, v FROM cur WHERE id NOT IN (SELECT id FROM inc)""")
def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("v"), "o_orderstatus", "o_totalprice")
    current = o.where("o_orderstatus = 'F'").groupBy("id").agg(F.min("v").alias("v")).withColumn("o_totalprice", F.lit(0.0))
    return store.upsert(current, o.where("o_orderstatus = 'O'").drop("o_orderstatus"), ["id"], "o_totalprice").select("id", "v")


@query("SELECT vec_id FROM embeddings WHERE NOT (label = 3 AND vec_id % 7 IN (1, 2))")
def delete_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("owner_id"), (F.col("vec_id") % 7).alias("document_id"))
    return store.delete_where(e, 3, document_id=[1, 2]).select("vec_id")


@query("""
SELECT CASE WHEN a < b THEN a ELSE b END AS low, CASE WHEN a < b THEN b ELSE a END AS high, max(l_extendedprice) AS score FROM (
  SELECT 'x' || (l_partkey % 500) AS a, 'x' || l_suppkey AS b, l_extendedprice FROM lineitem) WHERE a <> b GROUP BY 1, 2""")
def edge_dedupe_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("x"), F.col("l_partkey") % 500).alias("a"), F.concat(F.lit("x"), "l_suppkey").alias("b"), F.col("l_extendedprice").alias("score"))
    return rules.max_per_pair(li, "a", "b", "score")


@query("""
WITH bound AS (SELECT DISTINCT l_suppkey AS r, l_orderkey AS d FROM lineitem), link AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier),
way AS (SELECT a AS r, b AS v FROM link UNION SELECT b, a FROM link UNION SELECT DISTINCT r, r FROM bound)
SELECT way.r AS rule_id, count(DISTINCT d) AS documents FROM way JOIN bound ON bound.r = way.v GROUP BY way.r""")
def reachable_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("left_rule_id"), (F.col("s_suppkey") + 1).alias("right_rule_id"))
    bound = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rule_id"), F.col("l_orderkey").alias("document_id"))
    return rules.reachable_documents(links, bound)


@query("SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'P' AND epoch_ms(TIMESTAMP '2001-01-01') - epoch_ms(o_orderdate) >= 30000 THEN true ELSE false END AS resumable FROM orders")
def resumable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "P", "uploading").otherwise("ready")
    rows = o.select("o_orderkey", "o_orderdate", state.alias("status"), state.alias("stage"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.lit(None).cast("string").alias("workflow_run_id"), F.col("o_orderdate").alias("updated_at"))
    return rows.select("o_orderkey", "o_orderdate", repository.can_resume(F.lit("2001-01-01").cast(rows.schema["o_orderdate"].dataType).cast("timestamp")).alias("resumable"))


@query("SELECT doc_id, lower(coalesce(lang, '')) || ':' || printf('%06d', doc_id) AS chunk_id FROM documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.functions.ids import chunk_id

    return table(spark, sf_dir, "documents").select("doc_id", chunk_id(F.lower(F.coalesce("lang", F.lit(""))), F.col("doc_id")).alias("chunk_id"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS safe FROM documents")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.html_escape(F.col("text")).alias("safe"))
