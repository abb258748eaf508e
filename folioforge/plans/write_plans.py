"""Write checks, rule documents, paths and listings over the business tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import answers, folders, models, repository, retrieval, rules, search, semantic, spans, writes
from folioforge.plans.common import SPACE_SQL, query
from folioforge.plans.graph_plans import _KIND, _N, _V, _nation_links, _nation_nodes
from folioforge.plans.table_plans import _FILED, _FOLDERS, _KEY, _TREE, _filed, _folders
from folioforge.session import numbered, table
from folioforge.sources import detect
from folioforge.streaming import jobs

# --- folders ------------------------------------------------------------------------------------------------------

_ASKED = "CASE s_suppkey % 5 WHEN 0 THEN n_name WHEN 1 THEN ' ' WHEN 2 THEN 'New ' || (s_suppkey % 7) WHEN 3 THEN 'a/b' ELSE lower(n_name) END"
_PARENT = "CASE WHEN s_suppkey % 11 = 0 THEN 'X' WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'R' || (s_nationkey % 5) END"


@query(f"""
WITH {_FOLDERS.strip()}, req AS (SELECT s_suppkey AS request_id, {_ASKED} AS name, {_PARENT} AS parent_id FROM supplier JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT *, CASE WHEN length(trim(name)) NOT BETWEEN 1 AND 200 OR contains(name, '/') THEN 'name' WHEN parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM folders) THEN 'parent'
  WHEN EXISTS (SELECT 1 FROM folders f WHERE f.parent_id IS NOT DISTINCT FROM req.parent_id AND lower(f.name) = lower(trim(req.name))) THEN 'duplicate' END AS r FROM req)
SELECT request_id, coalesce(CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY parent_id, lower(trim(name)), r IS NULL ORDER BY request_id) > 1 THEN 'duplicate' ELSE r END, '') AS reason FROM c""")
def folder_create_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    asked = s.selectExpr("s_suppkey AS request_id", f"{_ASKED} AS name", f"{_PARENT} AS parent_id")
    return writes.create_folders(_folders(spark, sf_dir), asked).select("request_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query(f"""
WITH {_FOLDERS.strip()}, req AS (SELECT CASE WHEN a.n_nationkey % 7 = 0 THEN 'Z' ELSE 'N' END || a.n_nationkey AS id, CASE WHEN a.n_nationkey % 6 = 0 THEN 'x/y' ELSE lower(b.n_name) END AS name FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 5) % 25)
SELECT req.id, coalesce(CASE WHEN own.id IS NULL THEN 'missing' WHEN contains(req.name, '/') THEN 'name'
  WHEN EXISTS (SELECT 1 FROM folders f WHERE f.id <> req.id AND f.parent_id IS NOT DISTINCT FROM own.parent_id AND lower(f.name) = lower(req.name)) THEN 'duplicate' END, '') AS reason FROM req LEFT JOIN folders own ON own.id = req.id""")
def folder_rename_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    asked = n.alias("a").join(n.alias("b"), F.expr("b.n_nationkey = (a.n_nationkey + 5) % 25"))
    asked = asked.selectExpr("CASE WHEN a.n_nationkey % 7 = 0 THEN 'Z' ELSE 'N' END || a.n_nationkey AS id", "CASE WHEN a.n_nationkey % 6 = 0 THEN 'x/y' ELSE lower(b.n_name) END AS name")
    return writes.rename_folders(_folders(spark, sf_dir), asked).select("id", F.coalesce("reason", F.lit("")).alias("reason"))


@query(f"""
WITH {_FOLDERS.strip()}, {_FILED.strip()}, ids AS (SELECT id FROM folders UNION ALL SELECT 'X' || r_regionkey FROM region)
SELECT ids.id, coalesce(CASE WHEN ids.id NOT IN (SELECT id FROM folders) THEN 'missing' WHEN EXISTS (SELECT 1 FROM folders f WHERE f.parent_id = ids.id) OR EXISTS (SELECT 1 FROM filed WHERE folder_id = ids.id AND document_id LIKE 'S%') THEN 'not-empty' END, '') AS reason FROM ids""")
def folder_delete_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _folders(spark, sf_dir)
    ids = own.select("id").unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("X"), "r_regionkey").alias("id")))
    return writes.delete_folders(own, _filed(spark, sf_dir).where("document_id LIKE 'S%'"), ids).select("id", F.coalesce("reason", F.lit("")).alias("reason"))


@query(f"{_TREE} SELECT f.id FROM folders f WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.id = f.id AND up.ancestor IN ('R1', 'N3', 'N22'))")
def folder_trees_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("R1",), ("N3",), ("N22",)], "id string")
    return folders.delete_trees(_folders(spark, sf_dir), gone).select("id")


@query(f"WITH {_FILED.strip()} SELECT document_id, CASE WHEN document_id LIKE 'S%' AND length(document_id) = 2 THEN 'N5' ELSE folder_id END AS folder_id FROM filed")
def documents_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _filed(spark, sf_dir).withColumnRenamed("document_id", "id")
    moves = rows.where("id LIKE 'S%' AND length(id) = 2").select("id", F.lit("N5").alias("target"))
    return folders.move(rows, moves, "folder_id").select(F.col("id").alias("document_id"), "folder_id")


@query("""
WITH s AS (SELECT n_name, s_name, n_regionkey <> (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE') AS abroad, s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT 'europe' AS path, 'europe' AS name, 1 AS depth, false AS created UNION ALL SELECT DISTINCT 'europe/' || n_name, n_name, 2, abroad FROM s
UNION ALL SELECT 'europe/' || n_name || '/' || s_name, s_name, 3, abroad OR s_suppkey >= 10 FROM s""")
def folder_tree_ensured(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    files = s.select(F.concat(F.lit("europe/"), "n_name", F.lit("/"), "s_name", F.lit("/f.txt")).alias("relative_path"))
    return folders.ensure_tree(_folders(spark, sf_dir), folders.upload_plan(files), "o").select("path", "name", "depth", "created")


@query(f"WITH {_FOLDERS.strip()} SELECT id, row_number() OVER (ORDER BY {_KEY.replace('lower(t)', 'lower(name)')}, id) - 1 AS position FROM folders")
def folder_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(_folders(spark, sf_dir), repository.sort_folders(), "position").select("id", "position")


@query(f"""{_TREE}, clo AS (SELECT DISTINCT up.id FROM up WHERE ancestor IN ('R1', 'N3')), want AS (SELECT document_id FROM filed WHERE folder_id IN (SELECT id FROM clo) UNION SELECT 'C' || c_custkey FROM customer WHERE c_custkey % 50 = 1 AND c_custkey <= 15000)
SELECT document_id, CASE WHEN document_id LIKE '%9' THEN 'failed' ELSE 'deleted' END AS outcome FROM want""")
def bulk_delete_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _filed(spark, sf_dir)
    picked = table(spark, sf_dir, "customer").where("c_custkey % 50 = 1 AND c_custkey <= 15000").select(F.concat(F.lit("C"), "c_custkey").alias("document_id"))
    failed = docs.where("document_id LIKE '%9'").select("document_id", F.lit("m").alias("message"))
    return writes.bulk_delete(_folders(spark, sf_dir), docs, spark.createDataFrame([("R1",), ("N3",)], "id string"), picked, failed)[0].select("document_id", "outcome")


# --- documents and rules ------------------------------------------------------------------------------------------

_UUID = "11111111-1111-4111-8111-111111111111"
_DOCUMENT = ("CASE o_orderkey % 4 WHEN 1 THEN 'rule' WHEN 2 THEN 'knowledge' WHEN 3 THEN 'other' END", "CASE WHEN o_custkey % 2 = 0 THEN 'F' END", f"CASE o_orderkey % 3 WHEN 1 THEN '{_UUID}' WHEN 2 THEN 'x' END")


@query(f"""
SELECT id, coalesce(CASE WHEN k NOT IN ('knowledge', 'rule') THEN 'kind' WHEN k = 'rule' AND f IS NOT NULL THEN 'folder' WHEN r = 'x' THEN 'retry' END, '') AS reason FROM (
  SELECT o_orderkey AS id, coalesce({_DOCUMENT[0]}, 'knowledge') AS k, {_DOCUMENT[1]} AS f, {_DOCUMENT[2]} AS r FROM orders)""")
def document_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{_DOCUMENT[0]} AS document_kind", f"{_DOCUMENT[1]} AS folder_id", f"{_DOCUMENT[2]} AS retry_of_job_id")
    return writes.check_documents(asked).select("id", F.coalesce("reason", F.lit("")).alias("reason"))


@query("SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 3 = 0 THEN p_size % 2 = 0 ELSE p_size > 25 END AS enabled FROM part")
def rule_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") > 25).alias("enabled"), "p_size")
    toggles = p.where("rule_id % 3 = 0").select("rule_id", (F.col("p_size") % 2 == 0).alias("enabled"))
    return writes.set_enabled(p, toggles, "rule_id")[0].select("rule_id", "enabled")


@query("""
WITH bound AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 7),
near AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey + 1 IN (SELECT k FROM bound) UNION SELECT o_orderkey + 1 FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey IN (SELECT k FROM bound)),
reached AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey IN (SELECT k FROM bound UNION SELECT k FROM near))
SELECT c_custkey AS document_id, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_nationkey % 2 <> 0 THEN 'old' WHEN c_custkey IN (SELECT c FROM reached) THEN '' ELSE 'new' END AS warning FROM customer""")
def stale_rule_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    docs = c.selectExpr("c_custkey AS rule_document_id", "CASE WHEN c_nationkey % 2 = 0 THEN 'ready' ELSE 'failed' END AS extraction_status", "CASE WHEN c_custkey % 3 <> 0 THEN 'old' END AS extraction_warning")
    links = o.where("o_orderkey % 4 = 0").selectExpr("o_orderkey AS left_rule_id", "o_orderkey + 1 AS right_rule_id")
    got = writes.reach_warnings(docs, o.selectExpr("o_orderkey AS rule_id", "o_custkey AS rule_document_id"), li.where("l_linenumber = 7").selectExpr("l_orderkey AS rule_id"), links, "old", "new")
    return got.select(F.col("rule_document_id").alias("document_id"), F.coalesce("extraction_warning", F.lit("")).alias("warning"))


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
WHERE p_size < 10 AND s_nationkey < 12 AND s_acctbal >= 0 AND l_linenumber = 1 + s_suppkey % 4""")
def scoped_rule_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    bound = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("rule_id"), F.col("l_suppkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("version_id"), "l_orderkey", "l_linenumber")
    docs = s.selectExpr("s_suppkey AS document_id", "CAST(1 + s_suppkey % 4 AS long) AS latest_version_id", "CASE WHEN s_acctbal < 0 THEN 'deleting' ELSE 'active' END AS deletion_status")
    asked = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("rule_id"))
    return writes.scoped_bindings(bound, asked, docs, s.where("s_nationkey < 12").select(F.col("s_suppkey").alias("document_id"))).select("l_orderkey", "l_linenumber")


@query("""
SELECT o.chunk_id, o.rule_id, c_name AS title FROM (SELECT o_custkey % 50 AS chunk_id, max(o_orderkey) AS rule_id FROM orders GROUP BY 1) o JOIN customer ON c_custkey = o.chunk_id
WHERE c_nationkey % 2 = 0 AND c_acctbal >= 0""")
def rule_source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    applied = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS rule_id", "o_custkey AS rule_document_id", "o_custkey % 50 AS source_chunk_id", "o_totalprice AS score", "o_orderkey AS position")
    docs = c.selectExpr("c_custkey AS document_id", "c_name AS title", "CASE WHEN c_nationkey % 2 = 0 THEN 'rule' ELSE 'knowledge' END AS document_kind", "CASE WHEN c_acctbal < 0 THEN 'deleting' ELSE 'active' END AS deletion_status")
    return writes.rule_sources(applied, c.selectExpr("c_custkey AS chunk_id", "c_custkey AS document_id"), docs).select("chunk_id", "rule_id", "title")


@query("SELECT o_orderkey AS rule_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' AND c_acctbal > 0 AND c_nationkey % 3 <> 0")
def active_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS rule_id", "o_custkey AS rule_document_id", "o_orderstatus <> 'P' AS enabled")
    docs = table(spark, sf_dir, "customer").selectExpr("c_custkey AS rule_document_id", "c_acctbal > 0 AS enabled", "CASE WHEN c_nationkey % 3 <> 0 THEN 'ready' ELSE 'failed' END AS extraction_status")
    return search.active_rules(own, docs).select("rule_id")


@query("SELECT p_partkey AS rule_id, round(p_size / 50.0, 6) AS score FROM part WHERE p_size / 50.0 >= 0.35 AND p_partkey % 7 = 1 ORDER BY p_size DESC, p_partkey LIMIT 2")
def root_rule_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") / 50.0).alias("score"), (-F.col("p_size")).alias("rank"))
    return search.root_rules(p, p.where("rule_id % 7 = 1")).select("rule_id", F.round("score", 6).alias("score"))


_EDGES = rf"^{SPACE_SQL}|{SPACE_SQL}$"


@query(rf"""
SELECT doc_id, CASE WHEN length(t) BETWEEN 1 AND 2000 THEN '' ELSE 'length' END AS reason, substr(regexp_replace(split_part(t, chr(10), 1), '{_EDGES}', '', 'g'), 1, 60) AS title FROM (
  SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '{_EDGES}', '', 'g') AS t FROM documents)""")
def manual_rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", detect.manual_rule(F.coalesce("text", F.lit(""))).alias("m"))
    return d.select("doc_id", F.coalesce("m.reason", F.lit("")).alias("reason"), "m.title")


@query(rf"""
SELECT substr(regexp_replace(split_part(t, chr(10), 1), '{_EDGES}', '', 'g'), 1, 60) AS title, octet_length(encode(t)) AS size_bytes FROM (
  SELECT regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '{_EDGES}', '', 'g') AS t FROM documents) WHERE length(t) BETWEEN 1 AND 2000""")
def manual_rules_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = writes.create_manual_rules(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.coalesce("text", F.lit("")).alias("content")), "o")
    return made["documents"].join(made["document_versions"], "document_id").select("title", "size_bytes")


@query("""
WITH b AS (SELECT l_partkey AS rule_id, l_suppkey AS document_id, max(l_extendedprice) AS s FROM lineitem GROUP BY ALL), r AS (SELECT rule_id, document_id, s FROM b WHERE document_id <> 3 UNION ALL SELECT DISTINCT rule_id, 3, 1.0 FROM b)
SELECT rule_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY s DESC, document_id) AS k FROM r) WHERE k <= 20""")
def bindings_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("rule_id"), F.col("l_suppkey").alias("document_id")).agg(F.max("l_extendedprice").alias("vector_score"))
    found = b.select("rule_id").distinct().select("rule_id", F.lit(3).cast("long").alias("document_id"), F.lit(1.0).alias("vector_score"))
    b = b.select("rule_id", F.col("document_id").cast("long").alias("document_id"), F.col("vector_score").cast("double").alias("vector_score"))
    return rules.refresh_bindings(b, found, 3).select("rule_id", "document_id")


@query("SELECT l_partkey AS chunk_id, max(l_extendedprice) AS score FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 5) GROUP BY l_partkey ORDER BY max(l_extendedprice) DESC, l_partkey LIMIT 50")
def best_chunk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS chunk_id", "l_extendedprice AS score", "l_linenumber AS path_rank")
    return search.best_per_chunk(hits, table(spark, sf_dir, "part").where("p_size < 5").selectExpr("p_partkey AS chunk_id"), 50).select("chunk_id", "score")


@query("SELECT doc_id AS chunk_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN 'T' || doc_id END, 'Document') AS title, CASE WHEN doc_id % 2 = 0 OR (lang IS NULL AND source IS NULL) THEN 'Body' ELSE concat_ws(' › ', lang, source) END AS heading FROM documents")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS chunk_id", "CASE WHEN doc_id % 3 > 0 THEN 'T' || doc_id END AS title", "CASE WHEN doc_id % 2 = 1 THEN array(lang, source) END AS heading_path")
    return search.source_projection(d).select("chunk_id", "title", "heading")


@query("""
SELECT event_id, CASE WHEN f THEN 'failure' WHEN i THEN 'extractive' ELSE 'generated' END AS mode, CASE WHEN f THEN 'The answer could not be generated. ' || props WHEN i THEN props ELSE event_type END AS shown
FROM (SELECT event_id, event_type, coalesce(props, '') AS props, event_id % 5 = 0 AS f, coalesce(value < 10, true) AS i FROM events)""")
def answers_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS answer", "coalesce(props, '') AS extractive", "event_id % 5 = 0 AS failed", "coalesce(value < 10, true) AS insufficient_evidence")
    return answers.present(e).select("event_id", "mode", "shown")


@query("SELECT o_orderkey AS version_id, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'indexing' ELSE 'uploaded' END AS status FROM orders")
def version_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS version_id", "CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'indexing' ELSE 'odd' END AS s")
    return o.select("version_id", repository.version_status(F.col("s")).alias("status"))


_JOB = "CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'failed' ELSE 'processing' END"


@query(f"""
SELECT 'all' AS kind, o_orderkey AS job_id FROM orders UNION ALL SELECT 'running', o_orderkey FROM orders WHERE {_JOB} NOT IN ('ready', 'failed') UNION ALL SELECT 'failed', o_orderkey FROM orders WHERE {_JOB} = 'failed'""")
def job_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS job_id", f"{_JOB} AS status")
    parts = [repository.filter_jobs(o, k).select(F.lit(k).alias("kind"), "job_id") for k in ("all", "running", "failed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_RENAMED = "CASE s_suppkey % 5 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'a/b.pdf' WHEN 2 THEN 'a.txt' WHEN 3 THEN ' ' ELSE '.pdf' END"


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'characters' WHEN 2 THEN 'extension' WHEN 3 THEN 'length' ELSE 'empty' END AS reason FROM supplier")
def rename_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_name || '.pdf' AS old", f"{_RENAMED} AS new")
    return s.select("s_suppkey", F.coalesce(detect.rename_reason(F.col("old"), F.col("new")), F.lit("")).alias("reason"))


@query("SELECT c_custkey, c_custkey % 3 <> 1 AS allowed FROM customer WHERE c_nationkey = 3")
def owner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey AS owner_id", "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'app' END AS client_id")
    return repository.may_write(repository.owned(c, 3)).select("c_custkey", "allowed")


@query("""
SELECT l_orderkey, l_linenumber, (l_quantity >= 10)::INT AS n_spans, CASE WHEN l_quantity >= 10 THEN l_linenumber % 2 ELSE 0 END AS n_boxes FROM lineitem""")
def stored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = """concat('[{"x":0.1,"y":0,"width":', CASE WHEN l_linenumber % 2 = 1 THEN '0.5' ELSE '0' END, ',"height":1}]')"""
    text = f"""concat('[{{"blockId":"b","blockIndex":', l_linenumber, ',"startOffset":10,"endOffset":', cast(l_quantity AS int), ',"boxes":', {box}, '}},{{"blockIndex":1}}]')"""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", repository.parse_spans(F.expr(text)).alias("s"))
    return li.select("l_orderkey", "l_linenumber", F.size("s").alias("n_spans"), F.coalesce(F.size(F.get("s", 0)["boxes"]), F.lit(0)).alias("n_boxes")).withColumn("n_boxes", F.greatest(F.lit(0), "n_boxes"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END), ''), c_mktsegment) ELSE c_name || '.pdf' END AS title FROM customer")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    kind, typed = F.when(F.col("c_nationkey") % 2 == 0, "manual").otherwise("upload"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name"))
    return c.select("c_custkey", repository.document_title(kind, typed, F.col("c_mktsegment"), F.concat("c_name", F.lit(".pdf"))).alias("title"))


_SPACE = SPACE_SQL.removesuffix("+")
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"""
SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN (i - 1 - lead) % 2 = 0 AND ((i - 1 - lead) // 2 IN (2, 3, 6)) THEN '<mark class="chunk-range">' || {_ESC.format('x')} || '</mark>' ELSE {_ESC.format('x')} END), '') AS html
FROM (SELECT doc_id, p, regexp_matches(coalesce(p[1], ''), '^{_SPACE}')::INT AS lead FROM (SELECT doc_id, regexp_extract_all(text, '{_SPACE}+|{_SPACE.replace('[', '[^', 1)}+') AS p FROM documents WHERE text <> ''))""")
def highlighted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(*[F.struct(F.lit(a).alias("start_word"), F.lit(z).alias("end_word")) for a, z in ((2, 4), (6, 7))])
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", writes.highlight_words(F.col("text"), marks).alias("html"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN array_to_string(list_sort(list_distinct([o_custkey % 5, o_custkey % 3])), ',') ELSE array_to_string(range(1, 2 + o_custkey % 4), ',') END AS marked FROM orders")
def blocks_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.expr("CASE WHEN o_custkey % 2 = 0 THEN array(struct(cast(o_custkey % 5 AS long) AS block_index), struct(cast(o_custkey % 3 AS long) AS block_index)) ELSE array() END")
    got = spans.marked_blocks(F.col("s"), F.lit(1).cast("long"), (1 + F.col("o_custkey") % 4).cast("long"))
    return table(spark, sf_dir, "orders").withColumn("s", own).select("o_orderkey", F.array_join(got.cast("array<string>"), ",").alias("marked"))


@query("""
SELECT l_orderkey AS document_id, l_linenumber AS block_index, 'row' AS kind FROM lineitem UNION ALL
SELECT o_orderkey, coalesce((SELECT max(l_linenumber) + 1 FROM lineitem WHERE l_orderkey = o_orderkey), 0), 'image' FROM orders WHERE o_orderpriority LIKE '1%'""")
def insights_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS document_id", "cast(l_linenumber AS int) AS block_index", "'row' AS kind", "'t' AS text")
    more = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").selectExpr("o_orderkey AS document_id", "1 AS n", "'seen' AS text")
    return spans.append_insights(blocks, more).select("document_id", "block_index", "kind")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat_ws(chr(10), 'Alternative: ' || o_clerk, 'Text: ' || o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'Facts: a; b' END) END AS text
FROM (SELECT *, 'c' || o_custkey AS o_clerk FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders))""")
def insight_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.when(F.col("o_orderstatus") == "F", F.array(F.lit(" a"), F.lit(""), F.lit("b "))).otherwise(F.array().cast("array<string>"))
    seen = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(seen.alias("visibleText"), F.lit(" ").alias("description"), facts.alias("keyFacts"))).alias("j"), F.concat(F.lit("c"), "o_custkey").alias("alt"))
    return o.select("o_orderkey", models.insight_text(F.col("j"), F.col("alt")).alias("text"))


# --- jobs ---------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 0 AND s_nationkey <> 4 AND l_linenumber = 1 + s_suppkey % 4")
def reindexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS document_id", "CASE WHEN s_nationkey <> 4 THEN 'knowledge' ELSE 'rule' END AS document_kind", "CASE WHEN s_acctbal < 0 THEN 'deleting' END AS deletion_status", "cast(1 + s_suppkey % 4 AS long) AS latest_version_id")
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS document_id", "cast(l_linenumber AS long) AS version_id", "l_orderkey", "l_linenumber")
    return jobs.reindex_plan(docs, rows, rows.select("document_id"))[1].select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s_nationkey = 4 THEN 'New ' || s_suppkey ELSE s_name END || chr(10) || 'H' || chr(10) || 'body' AS sparse_text FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def renamed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS document_id", "l_orderkey", "l_linenumber", "'old' AS title", "array('H') AS heading_path", "'body' AS text")
    names = s.where("s_nationkey = 4").selectExpr("s_suppkey AS document_id", "'New ' || s_suppkey AS new_title")
    return jobs.renamed(s.selectExpr("s_suppkey AS document_id", "s_name AS title"), rows, names)[1].select("l_orderkey", "l_linenumber", "sparse_text")


@query("""
SELECT c_custkey AS document_id, CASE WHEN ok THEN 'new' ELSE 'old' END AS content, CASE WHEN ok THEN 'pending' ELSE 'ready' END AS status
FROM (SELECT c_custkey, c_custkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS ok FROM customer)""")
def rules_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS rule_document_id", "'old' AS manual_content", "'ready' AS extraction_status")
    work = table(spark, sf_dir, "orders").selectExpr("o_custkey AS document_id", "CASE WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'ready' END AS status")
    got = jobs.revise_rules(c, work, c.where("rule_document_id % 2 = 0").select("rule_document_id", F.lit("new").alias("content")))[0]
    return got.select(F.col("rule_document_id").alias("document_id"), F.col("manual_content").alias("content"), F.col("extraction_status").alias("status"))


_CLEAN = "o_orderstatus = 'F' AND o_custkey % 2 = 0"


@query(f"SELECT o_orderkey AS job_id, CASE WHEN NOT ({_CLEAN}) THEN 'claim' ELSE 'deletion' END AS reason FROM orders WHERE o_orderkey % 3 = 0 AND NOT ({_CLEAN} AND o_orderkey % 5 <> 0)")
def cleanups_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("document_id", F.col("o_orderkey")).withColumn("job_id", F.col("o_orderkey"))
    own = o.selectExpr("job_id", "document_id", "CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ready' END AS status", "CASE WHEN o_custkey % 2 = 0 THEN 1 END AS cleanup_started_at")
    docs = o.selectExpr("document_id", "CASE WHEN o_orderkey % 5 <> 0 THEN 'deleting' ELSE 'active' END AS deletion_status")
    done = o.where("o_orderkey % 3 = 0").selectExpr("job_id", "document_id", "o_orderkey AS deletion_job_id")
    return writes.complete_cleanups(own, docs, o.selectExpr("document_id", "o_orderkey AS deletion_job_id"), done)[2]


@query(f"SELECT o_orderkey AS job_id, CASE WHEN {_CLEAN} AND o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN repeat('m', 500) ELSE 'the cleanup failed' END ELSE '' END AS cleanup_error FROM orders")
def cleanups_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS job_id", "CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ready' END AS status", "CASE WHEN o_custkey % 2 = 0 THEN 1 END AS cleanup_started_at", "'' AS cleanup_error")
    said = own.where("job_id % 3 = 0").selectExpr("job_id", "CASE WHEN job_id % 2 = 0 THEN repeat('m', 700) ELSE ' ' END AS message")
    return writes.fail_cleanups(own, said).select("job_id", "cleanup_error")


@query("SELECT c_custkey AS document_id, CASE WHEN c_custkey % 3 = 1 THEN 'failed' ELSE 'pending' END AS status, (c_custkey % 3 = 1)::INT AS attempts FROM customer WHERE c_custkey % 3 <> 0")
def deletions_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").selectExpr("c_custkey AS document_id", "'pending' AS status", "0 AS attempts", "cast(NULL AS string) AS last_error")
    tried = own.where("document_id % 3 <> 2").selectExpr("document_id", "CASE WHEN document_id % 3 = 1 THEN 'gone wrong' END AS error")
    return writes.settle_deletions(own, tried).select("document_id", "status", "attempts")


# --- counts -------------------------------------------------------------------------------------------------------


@query(f"WITH {_N} SELECT (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_acctbal >= 0) AS owners, (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM link) AS links")
def rebuild_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS owner_id", "'knowledge' AS document_kind", "CASE WHEN c_acctbal < 0 THEN 'deleting' END AS deletion_status", "1 AS latest_version_id")
    none = docs.limit(0).selectExpr("owner_id", "'ready' AS extraction_status")
    return writes.rebuild_counts(docs, none, _nation_nodes(spark, sf_dir), _nation_links(spark, sf_dir))


@query("SELECT o_custkey AS rule_document_id, count(DISTINCT o_orderkey) AS rules, count(DISTINCT l_suppkey) AS documents, count(l_suppkey) AS reachable FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def rule_document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS rule_id", "o_custkey AS rule_document_id")
    return writes.rule_totals(own, table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS rule_id", "l_suppkey AS document_id"))


@query("SELECT count(*) AS total, count(*) FILTER (l_orderkey % 2 = 0) AS filtered FROM lineitem")
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("chunks"))
    return writes.chunk_totals(listing, F.col("l_orderkey") % 2 == 0)


@query("SELECT l_orderkey AS document_id, l_linenumber AS block_start FROM lineitem WHERE l_linenumber = 1 + l_orderkey % 3 AND l_suppkey % 4 = 0")
def preview_highlight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("concat_ws(':', l_orderkey, l_linenumber, l_suppkey) AS chunk_id", "l_orderkey AS document_id", "cast(l_linenumber AS long) AS version_id", "array(l_suppkey) AS source_spans", "l_linenumber AS block_start", "l_linenumber AS block_end", "l_suppkey")
    docs = rows.select("document_id").distinct().withColumn("latest_version_id", 1 + F.col("document_id") % 3)
    return writes.preview_highlights(rows, docs, rows.where("l_suppkey % 4 = 0")).select("document_id", "block_start")


# --- paths and searches -------------------------------------------------------------------------------------------

_PATHS = f"""
{_N}, node AS (SELECT n_nationkey AS n, {_KIND} AS kind FROM nation), ways AS (SELECT link_id, l AS a, r AS b, s FROM link UNION ALL SELECT link_id, r, l, s FROM link),
root AS (SELECT n, kind, 0.5 + n % 5 / 10.0 AS s FROM node WHERE n IN (0, 3, 6, 9)),
one AS (SELECT root.n AS root, NULL::INT AS via, b AS target, (root.s + ways.s) / 2 AS score, [link_id] AS ids FROM root JOIN ways ON a = root.n JOIN node t ON t.n = b AND t.kind = 'document'),
two AS (SELECT root.n AS root, x.b AS via, y.b AS target, (root.s + x.s + y.s) / 3 AS score, [x.link_id, y.link_id] AS ids FROM root JOIN ways x ON x.a = root.n JOIN node v ON v.n = x.b AND v.kind = 'rule' JOIN ways y ON y.a = x.b JOIN node t ON t.n = y.b AND t.kind = 'document'),
every AS (SELECT *, root || coalesce('>' || via, '') || '>' || target AS path_id FROM (SELECT * FROM one UNION ALL SELECT * FROM two)),
used AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, ids ORDER BY score DESC, path_id) AS r FROM every) WHERE r = 1 ORDER BY score DESC, path_id LIMIT 12)"""


def _used(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = _nation_nodes(spark, sf_dir)
    roots = nodes.where("node_id IN (0, 3, 6, 9)").select("node_id", "node_kind", (F.lit(0.5) + F.col("node_id") % 5 / 10.0).alias("score"))
    return roots, search.semantic_paths(roots, nodes, _nation_links(spark, sf_dir), most=12)


@query(f"""WITH {_PATHS}, a AS (SELECT n AS rule_node, 0 AS depth, NULL::INT AS parent, n NOT IN (SELECT root FROM used) AS standalone FROM root UNION ALL SELECT via, 1, root, false FROM used WHERE via IS NOT NULL)
SELECT rule_node, depth, coalesce(parent, -1) AS parent, standalone FROM (SELECT *, row_number() OVER (PARTITION BY rule_node ORDER BY depth, parent) AS k FROM a) WHERE k = 1""")
def rules_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, used = _used(spark, sf_dir)
    return search.applied_rules(roots, used, False).select("rule_node", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), "standalone")


@query(f"WITH {_PATHS} SELECT DISTINCT unnest(ids) AS link_id FROM used")
def links_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.applied_links(_used(spark, sf_dir)[1], _nation_links(spark, sf_dir)).select("link_id")


@query("SELECT p_partkey AS chunk_id FROM part WHERE p_size / 50.0 > 0.5 OR p_partkey % 50 < 10")
def seeds_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").selectExpr("p_partkey AS chunk_id", "p_partkey % 50 AS document_id", "p_size / 50.0 AS score")
    return search.prune_seeds(seeds, spark.range(10).withColumnRenamed("id", "document_id"), spark.range(1).select(F.lit(True).alias("flag"))).select("chunk_id")


@query("SELECT p_partkey AS node_id, 'document' AS node_kind FROM part WHERE p_size / 50.0 >= 0.5")
def root_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").selectExpr("p_partkey AS node_id", "p_size / 50.0 AS score")
    return search.root_candidates(docs.limit(0), docs).select("node_id", "node_kind")


@query(f"""WITH {_N}, docs AS (SELECT s_nationkey AS rule, list_sort(list(s_suppkey)) AS d FROM supplier GROUP BY s_nationkey), root(n, s) AS (VALUES (0, 0.9), (6, 0.7), (8, 0.5)),
ways AS (SELECT l AS a, r AS b, s FROM link UNION ALL SELECT r, l, s FROM link)
SELECT n::VARCHAR AS path_id, round(s, 6) AS score, len(d) AS documents FROM root JOIN docs ON rule = n
UNION ALL SELECT n || '>' || b, round((root.s + ways.s) / 2, 6), len(d) FROM root JOIN ways ON a = n JOIN docs ON rule = b""")
def rule_paths_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([(0, 0.9), (6, 0.7), (8, 0.5)], "rule_id long, score double")
    links = _nation_links(spark, sf_dir).select(F.col("left_node_id").alias("left_rule_id"), F.col("right_node_id").alias("right_rule_id"), F.col("semantic_score").alias("vector_score"))
    bound = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("rule_id"), F.col("s_suppkey").alias("document_id"))
    return rules.rule_paths(roots, links, bound, 1000).select("path_id", F.round("score", 6).alias("score"), F.size("document_ids").alias("documents"))


@query(f"WITH {_N}, c AS (SELECT greatest(1, ceil(sqrt(count(*))))::BIGINT AS c FROM nation) SELECT n_nationkey AS node_id, (n_nationkey % c) * 260.0::DOUBLE AS x, (n_nationkey // c) * 120.0::DOUBLE AS y FROM nation, c")
def grid_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.grid_layout(_nation_nodes(spark, sf_dir)).select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


_ASK = "license version the"


@query(f"""
WITH {_V}, r AS (SELECT vec_id AS rule_id, v.e, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM v JOIN documents ON doc_id = vec_id WHERE label <> 3),
n AS (SELECT count(*) AS n FROM r), tok AS (SELECT rule_id, len(t) AS len, unnest(t) AS term FROM r), q AS (SELECT unnest({_ASK.split()!r}) AS term),
p AS (SELECT rule_id, term, any_value(len) AS len, count(*) AS tf FROM tok JOIN q USING (term) GROUP BY rule_id, term), idf AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM p, n GROUP BY term),
b AS (SELECT rule_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / 256.0))), 9) AS score FROM p JOIN idf USING (term) GROUP BY rule_id ORDER BY score DESC, rule_id LIMIT 20),
a AS (SELECT r.rule_id, round(list_cosine_similarity(r.e, q.e), 9) AS score FROM r, (SELECT e FROM v WHERE vec_id = 7) q ORDER BY score DESC, rule_id LIMIT 20),
arms AS (SELECT rule_id, row_number() OVER (ORDER BY score DESC, rule_id) - 1 AS k FROM a UNION ALL SELECT rule_id, row_number() OVER (ORDER BY score DESC, rule_id) - 1 FROM b)
SELECT rule_id, round(sum(1.0 / (2 + k)), 6) AS score FROM arms GROUP BY rule_id ORDER BY round(sum(1.0 / (2 + k)), 9) DESC, rule_id LIMIT 6""")
def rule_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    own = e.join(table(spark, sf_dir, "documents"), F.col("doc_id") == F.col("vec_id")).select(F.col("vec_id").alias("rule_id"), F.coalesce("text", F.lit("")).alias("statement"), "embedding")
    asked = e.where("vec_id = 7").first().embedding
    return retrieval.rule_search(own, asked, _ASK, 6, e.where("label = 3").select(F.col("vec_id").alias("rule_id"))).select("rule_id", F.round("score", 6).alias("score"))


@query("""
SELECT doc_id::VARCHAR AS chunk_id, section, position FROM (
  SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS section, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) - 1 AS position FROM documents WHERE lang IN ('en', 'de', 'fr')) WHERE position < 20""")
def evidence_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three result lists of twenty hits each, one after the other."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", F.length("text").alias("score"))
    top = [d.where(F.col("lang") == x).orderBy(F.col("score").desc_nulls_first(), "chunk_id").limit(20) for x in ("en", "de", "fr")]
    return search.answer_evidence(*top).select("chunk_id", "section", F.col("position").cast("long").alias("position"))
