"""Jobs, deletions, stores, ids and highlights over the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import ids, sheets
from folioforge.operators import answers, repository, rules, semantic, spans
from folioforge.plans.common import query
from folioforge.plans.graph_plans import _N, _nation_links, _nation_nodes, _small_world
from folioforge.session import table
from folioforge.streaming import jobs


@query("""
SELECT document_id, array_to_string(list(path ORDER BY o_orderdate, path), ',') AS storage_paths, coalesce(bool_or(o_orderstatus IN ('F', 'O')), false) AS requires_vector_cleanup FROM (
  SELECT o_custkey AS document_id, o_orderdate, o_orderstatus, 'p/' || o_orderkey AS path FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0) GROUP BY document_id""")
def deletion_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    docs = c.select(F.col("c_custkey").alias("document_id"), F.lit("o").alias("owner_id"), F.lit("active").alias("deletion_status"), "c_acctbal")
    state = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "indexing").otherwise("uploaded")
    versions = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("p/"), "o_orderkey").alias("storage_path"), state.alias("status"))
    got = jobs.request_deletion(docs, versions, docs.where("c_acctbal < 0"))[1].where("size(storage_paths) > 0")
    return got.select("document_id", F.array_join("storage_paths", ",").alias("storage_paths"), "requires_vector_cleanup")


@query("""
SELECT c_custkey AS document_id, CASE WHEN c_nationkey = 3 THEN 'missing' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'failed' ELSE 'deleted' END AS outcome FROM customer""")
def bulk_delete_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), "c_nationkey")
    failed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("document_id"))
    return jobs.bulk_delete(c, c.where("c_nationkey <> 3"), failed)


@query("""
SELECT o_orderkey AS version_id, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'failed' ELSE 'processing' END AS status, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'failed' ELSE 'indexing' END AS stage
FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 5)""")
def job_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "failed").otherwise("indexing")
    versions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"), F.lit("o").alias("owner_id"), state.alias("status"))
    have = table(spark, sf_dir, "lineitem").where("l_linenumber = 5").select(F.col("l_orderkey").alias("version_id")).distinct()
    return jobs.backfill_jobs(versions, have).select("version_id", "status", "stage")


@query("""
SELECT user_id, event_id, event_type = 'error' AND (value IS NULL OR value < 10 OR epoch(TIMESTAMP '2024-02-01') - epoch(ts) > 300) AS claimed FROM events""")
def cleanup_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("ready")
    began = F.when(F.col("value") >= 10, F.col("ts").cast("timestamp"))
    rows = e.select("user_id", "event_id", status.alias("status"), began.alias("cleanup_started_at"))
    return jobs.claim_cleanups(rows, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("user_id", "event_id", "claimed")


@query("SELECT l_partkey, l_suppkey, arg_max(l_orderkey * 10 + l_linenumber, (l_extendedprice, -(l_orderkey * 10 + l_linenumber))) AS binding_id FROM lineitem GROUP BY l_partkey, l_suppkey")
def binding_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("binding_id"))
    return rules.dedupe_bindings(li, ["l_partkey", "l_suppkey"], "l_extendedprice", "binding_id").select("l_partkey", "l_suppkey", "binding_id")


@query("""
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr(h, 17, 1))::INT % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS node_id
FROM (SELECT doc_id, sha256('node:' || source || ':document:' || doc_id) AS h FROM documents)""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.node_id(F.col("source"), F.lit("document"), F.col("doc_id").cast("string")).alias("node_id"))


@query("SELECT user_id, max(event_id) AS generation, arg_max(event_type, event_id) AS answer FROM events GROUP BY user_id")
def stale_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("generation"), F.col("event_type").alias("answer"))
    return repository.version_gate(e, "user_id", "generation")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber AS row, min(l_suppkey % 20 + 1) AS lo, max(l_suppkey % 20 + 1) AS hi FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL),
g AS (SELECT *, row - row_number() OVER (PARTITION BY l_orderkey ORDER BY row) AS g FROM r)
SELECT l_orderkey, min(row)::BIGINT AS first_row, max(row)::BIGINT AS last_row, chr((64 + min(lo))::INT) || min(row) || ':' || chr((64 + max(hi))::INT) || max(row) AS cell_range FROM g GROUP BY l_orderkey, g""")
def sheet_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <> 3")
    cells = li.select(F.col("l_orderkey").alias("document_id"), F.lit("s").alias("sheet"), F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 20 + 1).alias("column"), F.lit("x").alias("text"))
    got = spans.sheet_regions(cells)
    corner = lambda c, r: F.concat(sheets.column_letters(F.col(c)), F.col(r).cast("string"))
    return got.select(
        F.col("document_id").alias("l_orderkey"), F.col("first_row").cast("long").alias("first_row"), F.col("last_row").cast("long").alias("last_row"),
        F.concat(corner("first_column", "first_row"), F.lit(":"), corner("last_column", "last_row")).alias("cell_range"),
    )


@query(f"""WITH {_N} SELECT link_id FROM link WHERE (l % 3 = 0) <> (r % 3 = 0)""")
def visible_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nation_nodes(spark, sf_dir)
    return semantic.visible_graph(nodes, _nation_links(spark, sf_dir), ["document-rule"])[1].select("link_id")


@query("""
WITH seed AS (SELECT doc_id, 0 AS section, doc_id AS position FROM documents WHERE lang = 'en'), rule AS (SELECT doc_id, 1 AS section, doc_id FROM documents WHERE lang IN ('en', 'de') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
more AS (SELECT doc_id, 2 AS section, doc_id FROM documents WHERE lang IN ('de', 'fr'))
SELECT doc_id AS chunk_id, min(section)::BIGINT AS section FROM (SELECT * FROM seed UNION ALL SELECT * FROM rule UNION ALL SELECT * FROM more) GROUP BY doc_id""")
def answer_sources_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("position"), "lang")
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    none = good.limit(0).withColumn("path_chunk_id", F.col("chunk_id"))
    got = answers.merge_sources(d.where("lang = 'en'"), d.where("lang IN ('en', 'de')"), d.where("lang IN ('de', 'fr')"), good, none)
    return got.select("chunk_id", F.col("section").cast("long").alias("section"))


@query("""
SELECT c_custkey, c_nationkey, coalesce(s_acctbal > 0, false) AS can_upload FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND s_nationkey = c_nationkey""")
def connection_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner_id"), F.col("c_custkey").alias("client_id"))
    rights = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("owner_id"), F.col("s_suppkey").alias("client_id"), (F.col("s_acctbal") > 0).alias("can_upload"))
    return repository.connections(grants, rights).select(F.col("client_id").alias("c_custkey"), F.col("owner_id").alias("c_nationkey"), "can_upload")


@query(f"""
WITH {_N}, ways AS (SELECT link_id, l AS node_id, r AS other_node, s FROM link UNION ALL SELECT link_id, r, l, s FROM link)
SELECT node_id, other_node, CASE WHEN other_node % 3 = 0 THEN 'rule' ELSE 'document' END AS other_kind, n_name AS title, 'text ' || other_node AS text, round(s, 6) AS semantic_score
FROM ways JOIN nation ON n_nationkey = other_node WHERE node_id % 3 = 0""")
def rule_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = _nation_nodes(spark, sf_dir), _nation_links(spark, sf_dir)
    evidence = links.select("link_id", F.lit(0).alias("ordinal"), F.col("left_node_id").alias("left_chunk_id"), F.col("right_node_id").alias("right_chunk_id"))
    chunks = nodes.select(F.col("node_id").alias("chunk_id"), F.concat(F.lit("text "), F.col("node_id").cast("string")).alias("text"))
    titles = _small_world(spark, sf_dir).select(F.col("node_id").alias("document_id"), F.col("n_name").alias("title"))
    got = repository.relations_of_rules(nodes, links, evidence, chunks, titles)
    return got.select("node_id", "other_node", "other_kind", "title", "text", F.round("semantic_score", 6).alias("semantic_score"))


@query("""
WITH b AS (SELECT doc_id, text, length(text) AS n, least(20, length(text)) AS a, least(45, length(text)) AS z FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, substr(text, 1, a) AS piece, false AS marked, 0 AS pos FROM b UNION ALL SELECT doc_id, substr(text, a + 1, z - a), true, a FROM b UNION ALL SELECT doc_id, substr(text, z + 1), false, z FROM b)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n, length(piece) AS size, marked FROM p WHERE piece <> ''""")
def highlight_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(z).alias("end")) for a, z in ((30, 45), (20, 35), (20, 20))])
    d = table(spark, sf_dir, "documents").where("length(text) > 0").withColumn("spans", marks)
    return spans.slices(d, "doc_id").select("doc_id", F.col("n").cast("long").alias("n"), F.length("piece").cast("long").alias("size"), "marked")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey % 9 END AS block_start, CASE WHEN o_orderpriority LIKE '1%' THEN o_custkey % 9 + 2 WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey % 9 END AS block_end,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'pdf' ELSE 'text' END AS source_type FROM orders""")
def stored_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("o_orderpriority").startswith("1")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey") % 9).alias("block_start"), F.when(first, F.col("o_custkey") % 9 + 2).alias("block_end"),
        F.lit(None).cast("long").alias("focus_block"), F.when(first, "pdf").otherwise("odt").alias("source_type"),
    )
    return repository.stored_document(rows).select("o_orderkey", "block_start", "block_end", "source_type")
