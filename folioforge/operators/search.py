"""Relation-aware search: seeds and rules found side by side, paths of one or two links, scoped second searches, one merged answer."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import DEFAULTS, Settings
from folioforge.session import stored

log = logging.getLogger(__name__)


def latest_hits(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits of the current version of their active document; the order of the rest is kept."""
    live = documents.where("coalesce(deletion_status, 'active') = 'active' AND latest_version_id IS NOT NULL") if "deletion_status" in documents.columns else documents.where("latest_version_id IS NOT NULL")
    return hits.join(live.select("document_id", F.col("latest_version_id").alias("version_id")), ["document_id", "version_id"], "left_semi")


def active_rules(rules: DataFrame, rule_documents: DataFrame) -> DataFrame:
    """Enabled rules whose document is enabled and extracted."""
    return rules.where("enabled").join(rule_documents.where("enabled AND extraction_status = 'ready'").select("rule_document_id"), "rule_document_id", "left_semi")


def root_rules(hits: DataFrame, rules: DataFrame, least: float = DEFAULTS.relation_threshold, most: int = DEFAULTS.max_root_rules) -> DataFrame:
    """The first `most` hits (rule_id, score, rank) from the threshold on that are among the active rules."""
    return hits.where(F.col("score") >= least).join(rules.select("rule_id"), "rule_id", "left_semi").orderBy("rank", "rule_id").limit(most)


def root_candidates(rules: DataFrame, documents: DataFrame, least: float = DEFAULTS.document_root_threshold) -> DataFrame:
    """(node_id, node_kind, score): rule roots alone where there is one; else document roots from the threshold on."""
    some = rules.agg((F.count(F.lit(1)) > 0).alias("some"))
    r = rules.select("node_id", F.lit("rule").alias("node_kind"), "score")
    d = documents.where(F.col("score") >= least).select("node_id", F.lit("document").alias("node_kind"), "score")
    return r.unionByName(d.crossJoin(F.broadcast(some)).where("NOT some").drop("some"))  # one flag


def top_links(links: DataFrame, most: int | None = DEFAULTS.max_links_scanned) -> DataFrame:
    """The `most` links of highest score; all where it is None."""
    if most is None:
        return links
    return links.orderBy(F.col("semantic_score").desc(), "link_id").limit(most)


def semantic_paths(roots: DataFrame, nodes: DataFrame, links: DataFrame, active: DataFrame | None = None, most: int = DEFAULTS.max_paths) -> DataFrame:
    """(path_id, root_node, root_kind, via_node, target_node, document_id, score, link_ids): the best paths from roots to documents.

    From any root one link leads to another document; from a rule root two links may, by way of another rule. A
    path scores the mean of its root and links. Rule roots come first, then scores; of paths with the same
    target and links the best stays. nodes(node_id, node_kind, document_id); active(document_id) limits targets.
    """
    edge = links.select("link_id", F.col("left_node_id").alias("a"), F.col("right_node_id").alias("b"), "semantic_score")
    both = edge.unionByName(edge.select("link_id", F.col("b").alias("a"), F.col("a").alias("b"), "semantic_score"))
    targets = nodes.where("node_kind = 'document'")
    if active is not None:
        targets = targets.join(active.select("document_id"), "document_id", "left_semi")
    targets = targets.select(F.col("node_id").alias("target_node"), "document_id")
    rule_nodes = nodes.where("node_kind = 'rule'").select(F.col("node_id").alias("b"))
    r = roots.select(F.col("node_id").alias("a"), F.col("node_kind").alias("root_kind"), "score")
    one = r.join(both, "a").where("a <> b").withColumnRenamed("b", "target_node").join(targets, "target_node")
    none = F.lit(None).cast(nodes.schema["node_id"].dataType)
    one = one.select(F.col("a").alias("root_node"), "root_kind", none.alias("via_node"), "target_node", "document_id", ((F.col("score") + F.col("semantic_score")) / 2).alias("score"), F.array("link_id").alias("link_ids"))
    first = r.where("root_kind = 'rule'").join(both, "a").join(rule_nodes, "b", "left_semi").where("a <> b")
    first = first.select(F.col("a").alias("root_node"), "root_kind", "score", F.col("b").alias("via_node"), F.col("semantic_score").alias("s1"), F.col("link_id").alias("l1"))
    second = both.select(F.col("a").alias("via_node"), F.col("b").alias("target_node"), F.col("semantic_score").alias("s2"), F.col("link_id").alias("l2"))
    two = first.join(second, "via_node").where("target_node <> root_node AND target_node <> via_node").join(targets, "target_node")
    two = two.select("root_node", "root_kind", "via_node", "target_node", "document_id", ((F.col("score") + F.col("s1") + F.col("s2")) / 3).alias("score"), F.array("l1", "l2").alias("link_ids"))
    every = one.unionByName(two).withColumn("path_id", F.concat_ws(">", F.col("root_node").cast("string"), F.col("via_node").cast("string"), F.col("target_node").cast("string")))
    return prioritise(_best_of_same(every), most)


def _best_of_same(paths: DataFrame) -> DataFrame:
    order = Window.partitionBy("target_node", "link_ids").orderBy((F.col("root_kind") == "rule").desc(), F.col("score").desc(), "path_id")
    return paths.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def prioritise(paths: DataFrame, most: int) -> DataFrame:
    """Rule roots before document roots, then the higher score."""
    return paths.orderBy((F.col("root_kind") == "rule").desc(), F.col("score").desc(), "path_id").limit(most)


def prune_seeds(seeds: DataFrame, paths: DataFrame, prune: DataFrame, least: float = DEFAULTS.seed_keep_threshold) -> DataFrame:
    """The seeds; where prune(flag) holds only those above the threshold or in a document at the end of a path."""
    on_path = paths.select("document_id").distinct().withColumn("_on", F.lit(True))
    rows = seeds.join(on_path, "document_id", "left").crossJoin(F.broadcast(prune.select("flag")))  # one flag
    return rows.where(~F.col("flag") | (F.col("score") > least) | F.col("_on").isNotNull()).drop("_on", "flag")


def best_per_chunk(hits: DataFrame, seeds: DataFrame, most: int = DEFAULTS.max_expanded) -> DataFrame:
    """Of hits(chunk_id, score, path_rank, ...) the best of each chunk (the earlier path of equals), without the seeds' chunks."""
    order = Window.partitionBy("chunk_id").orderBy(F.col("score").desc(), "path_rank")
    rows = hits.join(seeds.select("chunk_id"), "chunk_id", "left_anti").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return rows.orderBy(F.col("score").desc(), "chunk_id").limit(most)


def applied_rules(roots: DataFrame, used: DataFrame, explicit_scope: bool) -> DataFrame:
    """(rule_node, depth, parent, standalone): root rules first, then the rules on used paths; each once.

    With an explicit scope only rules on used paths count.
    """
    on = used.where("root_kind = 'rule'")
    here = on.select(F.col("root_node").alias("rule_node")).distinct().withColumn("_on", F.lit(True))
    none = F.lit(None).cast(roots.schema["node_id"].dataType)
    r = roots.select(F.col("node_id").alias("rule_node")).join(here, "rule_node", "left").select("rule_node", F.lit(0).alias("depth"), none.alias("parent"), F.col("_on").isNull().alias("standalone"))
    if explicit_scope:
        r = r.where("NOT standalone")
    v = on.where("via_node IS NOT NULL").select(F.col("via_node").alias("rule_node"), F.lit(1).alias("depth"), F.col("root_node").alias("parent"), F.lit(False).alias("standalone"))
    every = r.unionByName(v)
    order = Window.partitionBy("rule_node").orderBy("depth", "parent")
    return every.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def applied_links(used: DataFrame, links: DataFrame) -> DataFrame:
    """The links of the used paths, each once."""
    ids = used.select(F.explode("link_ids").alias("link_id")).distinct()
    return links.join(ids, "link_id", "left_semi")


def rule_evidence(applied: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks that applied rules come from, with titles: applied(rule_id, rule_document_id, source_chunk_id, score, position).

    Where rules share a chunk the last one speaks for it.
    """
    order = Window.partitionBy("source_chunk_id").orderBy(F.col("position").desc())
    last = applied.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    live = documents.where("coalesce(deletion_status, 'active') = 'active'") if "deletion_status" in documents.columns else documents
    rows = last.join(chunks.withColumnRenamed("chunk_id", "source_chunk_id"), "source_chunk_id").join(live.select("document_id", "title"), "document_id")
    return rows.withColumnRenamed("source_chunk_id", "chunk_id").withColumn("role", F.lit("rule")).orderBy(F.col("score").desc(), "rule_id")


def source_projection(hits: DataFrame) -> DataFrame:
    """Hits as shown: a title and a heading line are always there."""
    heading = F.array_join(F.filter(F.coalesce("heading_path", F.array().cast("array<string>")), lambda h: h.isNotNull()), " › ")
    return hits.withColumn("title", F.coalesce("title", F.lit("Document"))).withColumn("heading", F.when(heading == "", "Body").otherwise(heading))


@dataclass
class Found:
    """What a search returns; every part is a DataFrame."""

    seeds: DataFrame
    rules: DataFrame
    expanded: DataFrame
    paths: DataFrame
    links: DataFrame
    mode: str


Search = Callable[[DataFrame | None, int], DataFrame]


def unified_search(
    content: Search, rules: Callable[[], DataFrame], scoped: Callable[[DataFrame], DataFrame], *, documents: DataFrame, rule_table: DataFrame, nodes: DataFrame,
    links: DataFrame, scope: DataFrame | None = None, top_k: int = 8, settings: Settings = DEFAULTS,
) -> Found:
    """The whole search.

    content(scope, limit) -> hits(chunk_id, document_id, version_id, score, ...); rules() -> hits(rule_id, score, rank);
    scoped(paths) -> hits(path_id, chunk_id, document_id, version_id, score, ...), at most four per path's document.
    rule_table(rule_id, ...) are the active rules; nodes(node_id, node_kind, document_id, rule_id). An error of the
    content search is raised. What the rules' provider raises costs the rules, what the scoped search raises costs
    the expansion: seeds and root rules stay, the error is logged and the mode says 'fallback'. Providers' answers are
    stored before they are used, so their errors come here and not later; errors of this function itself are raised.
    """
    empty = nodes.limit(0)
    limit = min(2 * top_k, 40)
    if scope is not None and scope.isEmpty():
        nothing = content(scope, limit).limit(0)
        return Found(nothing, empty, nothing, empty, links.limit(0), "content-only")
    hits = latest_hits(content(scope, limit), documents).orderBy(F.round("score", 9).desc(), "chunk_id")  # sums that differ in their last bits are ties
    seeds = hits.limit(min(top_k, settings.max_seeds))
    try:
        asked = stored(rules(), "rule-hits")
    except Exception:
        log.warning("the search for rules failed", exc_info=True)
        return Found(seeds, _no_rules(nodes), hits.limit(0), empty, links.limit(0), "fallback")
    rr = root_rules(asked, rule_table, settings.relation_threshold, settings.max_root_rules).join(nodes.where("node_kind = 'rule'").select("rule_id", "node_id"), "rule_id")
    seeded = seeds.join(nodes.where("node_kind = 'document'").select("document_id", "node_id"), "document_id").groupBy("node_id").agg(F.max("score").alias("score"))
    roots = root_candidates(rr, seeded, settings.document_root_threshold)
    active = latest_documents(documents)
    if scope is not None:
        active = active.join(scope.select("document_id"), "document_id", "left_semi")
    paths = semantic_paths(roots, nodes, top_links(links, settings.max_links_scanned), active, settings.max_paths)
    paths = paths.withColumn("path_rank", F.row_number().over(Window.orderBy((F.col("root_kind") == "rule").desc(), F.col("score").desc(), "path_id")))
    try:
        answered = stored(scoped(paths), "scoped-hits")
    except Exception:
        log.warning("the searches along paths failed", exc_info=True)
        return Found(seeds, applied_rules(rr, paths.limit(0), scope is not None), hits.limit(0), empty, links.limit(0), "fallback")
    more = latest_hits(answered, documents).join(paths.select("path_id", "path_rank"), "path_id")
    flag = rr.agg((F.count(F.lit(1)) > 0).alias("a")).crossJoin(more.agg((F.count(F.lit(1)) > 0).alias("b"))).select((F.col("a") & F.col("b")).alias("flag"))  # one row each
    with_hits = paths.join(more.select("path_id").distinct(), "path_id", "left_semi")
    kept = prune_seeds(seeds, with_hits, flag, settings.seed_keep_threshold)
    expanded = best_per_chunk(more, kept, settings.max_expanded)
    used = paths.join(expanded.select("path_id").distinct(), "path_id", "left_semi")
    applied = applied_rules(rr, used, scope is not None)
    mode = "content-only" if expanded.isEmpty() else "expanded"
    return Found(kept, applied, expanded, used, applied_links(used, links), mode)


def legacy_search(
    content: Search, rules: Callable[[], DataFrame], scoped: Callable[[DataFrame], DataFrame], *, documents: DataFrame, rule_table: DataFrame,
    links: DataFrame, bindings: DataFrame, scope: DataFrame | None = None, top_k: int = 4, settings: Settings = DEFAULTS,
) -> Found:
    """The search along links between rules and their bindings, as it was before documents had links of their own.

    content(scope, limit) and rules() as in `unified_search`; links(left_rule_id, right_rule_id, vector_score);
    bindings(rule_id, document_id, version_id, ...); scoped(paths with path_id, document_ids) -> hits(path_id, chunk_id,
    document_id, version_id, score). Failures of providers fall back as there: without rules to 'fallback', without paths
    to the seeds and the root rules.
    """
    from folioforge.operators.rules import rule_paths
    from folioforge.operators.writes import scoped_bindings

    limit = min(2 * top_k, 40)
    none = rule_table.limit(0).select(F.col("rule_id").alias("rule_node"), F.lit(0).alias("depth"), F.col("rule_id").alias("parent"), F.lit(True).alias("standalone"))
    hits = latest_hits(content(scope, limit), documents).orderBy(F.col("score").desc(), "chunk_id")
    seeds = hits.limit(min(top_k, settings.max_seeds))
    if scope is not None and scope.isEmpty():
        return Found(seeds.limit(0), none, hits.limit(0), none, links.limit(0), "content-only")
    try:
        asked = stored(rules(), "rule-hits")
    except Exception:
        log.warning("the search for rules failed", exc_info=True)
        return Found(seeds, none, hits.limit(0), none, links.limit(0), "fallback")
    roots = stored(root_rules(asked, rule_table, settings.relation_threshold, settings.max_root_rules).select("rule_id", "score"), "root-rules")  # at most two
    alone = roots.select(F.col("rule_id").alias("rule_node"), F.lit(0).alias("depth"), F.lit(None).cast(roots.schema["rule_id"].dataType).alias("parent"), F.lit(True).alias("standalone"))
    if scope is not None:
        alone = alone.limit(0)
    known = rule_table.select("rule_id")
    live = links.join(known.withColumnRenamed("rule_id", "left_rule_id"), "left_rule_id", "left_semi").join(known.withColumnRenamed("rule_id", "right_rule_id"), "right_rule_id", "left_semi")
    paths = stored(rule_paths(roots, live, scoped_bindings(bindings, known, documents, scope), settings.max_paths), "rule-paths")
    try:
        answered = stored(scoped(paths), "scoped-hits")
    except Exception:
        log.warning("the searches along paths failed", exc_info=True)
        return Found(seeds, alone, hits.limit(0), paths.limit(0), links.limit(0), "content-only")
    order = Window.orderBy(F.col("score").desc(), "path_id")  # two paths
    ranked = paths.withColumn("path_rank", F.row_number().over(order))
    more = latest_hits(answered, documents).join(ranked.select("path_id", "path_rank"), "path_id")
    if more.isEmpty():
        return Found(seeds, alone, hits.limit(0), paths.limit(0), links.limit(0), "content-only")
    used = paths.join(more.select("path_id").distinct(), "path_id", "left_semi")
    on_path = used.select(F.explode("document_ids").alias("document_id"))
    flag = roots.sparkSession.range(1).select(F.lit(True).alias("flag"))
    kept = prune_seeds(seeds, on_path, flag, settings.seed_keep_threshold)
    expanded = best_per_chunk(more, kept, settings.max_expanded)
    shaped = used.select(F.lit("rule").alias("root_kind"), F.col("root_rule").alias("root_node"), F.col("linked_rule").alias("via_node"))
    applied = applied_rules(roots.withColumnRenamed("rule_id", "node_id"), shaped, scope is not None)
    return Found(kept, applied, expanded, used, live, "content-only" if expanded.isEmpty() else "expanded")


def _no_rules(nodes: DataFrame) -> DataFrame:
    """An empty table as `applied_rules` gives it."""
    none = F.lit(None).cast(nodes.schema["node_id"].dataType)
    return nodes.limit(0).select(F.col("node_id").alias("rule_node"), F.lit(0).alias("depth"), none.alias("parent"), F.lit(True).alias("standalone"))


def answer_evidence(seeds: DataFrame, rules: DataFrame, expanded: DataFrame) -> DataFrame:
    """(section, position, chunk_id, score): all evidence in one ordered list, seeds, then rules, then what paths led to. Nothing is merged."""
    parts = []
    for n, (name, rows) in enumerate((("seed", seeds), ("rule", rules), ("expanded", expanded))):
        # Each part is a top-k of its own, in the order in which it was found.
        tie = "rule_id" if name == "rule" and "rule_id" in rows.columns else "chunk_id"
        place = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(tie))) - 1
        parts.append(rows.select(F.lit(n).alias("section"), F.lit(name).alias("role"), place.alias("position"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("score").cast("double").alias("score")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("section", "position")


def latest_documents(documents: DataFrame) -> DataFrame:
    rows = documents.where("latest_version_id IS NOT NULL")
    return rows.where("coalesce(deletion_status, 'active') = 'active'") if "deletion_status" in rows.columns else rows
