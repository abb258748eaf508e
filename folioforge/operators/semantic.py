"""The semantic graph: representatives, similarity self-join, link aggregation, rebuild and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import DEFAULTS
from folioforge.functions.ids import link_id
from folioforge.functions.scores import calibrated, clamp, pair_floor
from folioforge.operators.nearest import nearest
from folioforge.session import numbered, stored


def representatives(chunks: DataFrame, key: str = "document_id", most: int = DEFAULTS.max_segments) -> DataFrame:
    """At most `most` chunks of each document, in order: all if they are few; else the first, the last, the first of
    each new heading path, then evenly spaced ones, then the next in order.
    """
    rows = chunks.where(F.trim("text") != "")
    heading = F.array_join(F.transform(F.coalesce("heading_path", F.array().cast("array<string>")), lambda h: F.trim(F.coalesce(h, F.lit("")))), "\x1f")
    order = Window.partitionBy(key).orderBy("ordinal")
    rows = rows.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    rows = rows.withColumn("_new", F.row_number().over(Window.partitionBy(key, heading).orderBy("ordinal")) == 1)
    # One array of picks a document, each step adding what is not there yet until it is full.
    per = rows.groupBy(key).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_new"), F.col("_i")))).alias("heads"))
    take = lambda a: F.slice(F.array_distinct(a), 1, most)
    per = per.withColumn("a", take(F.concat(F.array(F.lit(0), F.col("n") - 1), "heads")))
    per = per.withColumn("slots", F.lit(most) - F.size("a"))
    spaced = F.when(
        F.col("slots") > 0, F.transform(F.sequence(F.lit(1), F.col("slots")), lambda i: F.floor(i * (F.col("n") - 1) / (F.col("slots") + 1) + 0.5).cast("int"))
    ).otherwise(F.array().cast("array<int>"))
    per = per.withColumn("b", take(F.concat(F.transform("a", lambda x: x.cast("int")), spaced)))
    per = per.withColumn("picks", F.when(F.col("n") <= most, F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).otherwise(take(F.concat("b", F.sequence(F.lit(0), F.lit(most - 1))))))
    picked = per.select(key, F.explode("picks").alias("_i"))
    return rows.join(picked, [key, "_i"], "left_semi").drop("_i", "_n", "_new")


def content_hash(segments: DataFrame, key: str = "document_id", id_: str = "chunk_id", order: str = "ordinal") -> DataFrame:
    """(key, content_hash): SHA-256 over id and text of the segments in order."""
    rows = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.concat(F.col(id_), F.lit(":"), F.col("text")).alias("t")))).alias("xs"))
    return rows.select(key, F.sha2(F.array_join(F.transform("xs", lambda x: x["t"]), "\n"), 256).alias("content_hash"))


def similar_segments(segments: DataFrame, least: float, most: int = DEFAULTS.segment_hits) -> DataFrame:
    """(owner_id, embedding_model, segment, node, other, other_node, raw): the `most` nearest segments of other nodes, same owner and model.

    segments(owner_id, embedding_model, node_id, segment_id, embedding), ids being longs.
    """
    keys = ["owner_id", "embedding_model"]
    rows = segments.select(*keys, F.col("segment_id").alias("id"), F.col("node_id").alias("grp"), F.col("embedding").alias("vector"))
    near = nearest(rows, rows, most, least, keys, other_group=True)
    return near.select(*keys, F.col("query_id").alias("segment"), F.col("query_grp").alias("node"), F.col("id").alias("other"), F.col("grp").alias("other_node"), F.col("score").alias("raw"))


def refreshed_segments(matches: DataFrame, before: DataFrame, after: DataFrame, least: float, most: int = DEFAULTS.segment_hits) -> DataFrame:
    """`similar_segments` of `after`, from the matches of `before`: only what changed is searched for again.

    Segments are known by owner, model and id, and change with their node or the content of their vector. Searched anew are the new
    and changed ones, and those that lose a place of a full list; of all others the lists only take in what is new. A list that was
    not full held all above `least`, so it may lose places without a search.
    """
    keys = ["owner_id", "embedding_model"]
    known = [*keys, "node_id", "segment_id"]
    coded = lambda rows: rows.select(*known, "embedding", F.xxhash64("embedding").alias("_a"), F.xxhash64(F.lit(7), "embedding").alias("_b"))
    old, new = coded(before), coded(after)
    same = [*known, "_a", "_b"]
    gone = stored(old.join(new, same, "left_anti").select(*keys, "segment_id"), "segments-gone")
    fresh = stored(new.join(old, same, "left_anti").drop("_a", "_b"), "segments-fresh")
    kept = new.join(old.select(*same), same, "left_semi").drop("_a", "_b")
    own = matches.join(gone.withColumnRenamed("segment_id", "segment"), [*keys, "segment"], "left_anti")
    left = own.join(gone.withColumnRenamed("segment_id", "other"), [*keys, "other"], "left_anti")
    full = own.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= most)
    now = left.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("_left"))
    short = full.join(now, [*keys, "segment"], "left").where(F.coalesce("_left", F.lit(0)) < F.col("_n")).select(*keys, F.col("segment").alias("segment_id"))
    short = stored(short, "segments-short")
    pick = lambda rows: rows.select(*keys, F.col("segment_id").alias("id"), F.col("node_id").alias("grp"), F.col("embedding").alias("vector"))
    again = fresh.unionByName(kept.join(short, [*keys, "segment_id"], "left_semi"))
    named = [*keys, F.col("query_id").alias("segment"), F.col("query_grp").alias("node"), F.col("id").alias("other"), F.col("grp").alias("other_node"), F.col("score").alias("raw")]
    searched = nearest(pick(again), pick(new), most, least, keys, other_group=True).select(named)
    entering = nearest(pick(kept.join(short, [*keys, "segment_id"], "left_anti")), pick(fresh), most, least, keys, other_group=True).select(named)
    stays = left.join(short.withColumnRenamed("segment_id", "segment"), [*keys, "segment"], "left_anti").select(*entering.columns)
    order = Window.partitionBy(*keys, "segment").orderBy(F.round("raw", 9).desc(), "other")
    merged = stays.unionByName(entering).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
    return searched.unionByName(merged)


def greedy_pairs(matches: Column, most: int = DEFAULTS.max_pairs_per_link) -> Column:
    """Of structs (score, a, b) in order the first `most` that share neither a nor b."""
    start = F.filter(matches, lambda _: F.lit(False))
    return F.aggregate(
        matches, start, lambda got, x: F.when((F.size(got) >= most) | F.exists(got, lambda g: (g["a"] == x["a"]) | (g["b"] == x["b"])), got).otherwise(F.array_append(got, x))
    )


def link_candidates(matches: DataFrame, nodes: DataFrame, least: float = DEFAULTS.link_threshold, model: str | None = None, settings=DEFAULTS) -> DataFrame:
    """(owner_id, node, other_node, score, coverage, n_pairs, pairs): links each node would choose, best first, at most five.

    matches as `similar_segments` gives them; nodes(node_id, segment_count). A link's score is 0.8 times the mean
    of its one-to-one pairs plus 0.2 times its coverage.
    """
    score = calibrated(F.col("raw"), model) if model else calibrated(F.col("raw"), F.col("embedding_model"))
    rows = matches.withColumn("score", score).where(F.col("score") >= pair_floor(F.lit(least)))
    item = F.struct((-F.col("score")).alias("neg"), F.col("segment").alias("a"), F.col("other").alias("b"), F.col("score"))
    got = rows.groupBy("owner_id", "node", "other_node").agg(F.array_sort(F.collect_list(item)).alias("xs"))  # bounded: segments of two nodes
    got = got.withColumn("ps", greedy_pairs(F.col("xs"), settings.max_pairs_per_link))
    sizes = nodes.select("node_id", "segment_count")
    got = got.join(sizes.withColumnRenamed("node_id", "node").withColumnRenamed("segment_count", "ca"), "node")
    got = got.join(sizes.withColumnRenamed("node_id", "other_node").withColumnRenamed("segment_count", "cb"), "other_node")
    need = F.greatest(F.lit(1), F.least(F.lit(settings.max_pairs_per_link), "ca", "cb"))
    mean = F.aggregate("ps", F.lit(0.0), lambda a, x: a + x["score"]) / F.size("ps")
    got = got.withColumn("coverage", F.least(F.lit(1.0), F.size("ps") / need)).withColumn("score", clamp(0.8 * mean + 0.2 * F.col("coverage"))).where(F.col("score") >= least)
    best = Window.partitionBy("node").orderBy(F.col("score").desc(), "other_node")
    got = got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= settings.max_links_per_node)
    pairs = F.transform("ps", lambda x, i: F.struct(i.alias("ordinal"), x["a"].alias("segment"), x["b"].alias("other"), x["score"].alias("pair_score")))
    return got.select("owner_id", "node", "other_node", "score", "coverage", F.size("ps").alias("n_pairs"), pairs.alias("pairs"), "rank")


def rebuild_links(candidates: DataFrame, order: DataFrame) -> DataFrame:
    """The links after all nodes were refreshed in order(node_id, position): the later node of a pair decides.

    A refresh removes all links of a node and adds its own choice, so what stays of a pair is the choice of the
    node that came last.
    """
    p = order.select("node_id", "position")
    rows = candidates.join(p.withColumnRenamed("node_id", "node").withColumnRenamed("position", "pa"), "node")
    rows = rows.join(p.withColumnRenamed("node_id", "other_node").withColumnRenamed("position", "pb"), "other_node").where("pa > pb")
    return _canonical(rows)


def _canonical(rows: DataFrame) -> DataFrame:
    a, b = F.col("node").cast("string"), F.col("other_node").cast("string")
    return rows.select(
        link_id(F.col("owner_id").cast("string"), a, b).alias("link_id"), "owner_id", F.least(a, b).alias("left_node_id"), F.greatest(a, b).alias("right_node_id"),
        F.col("score").alias("semantic_score"), F.col("coverage").alias("coverage_score"), F.col("n_pairs").alias("matched_pair_count"),
        F.transform("pairs", lambda x: F.struct(x["ordinal"].alias("ordinal"), F.when(a < b, x["segment"]).otherwise(x["other"]).alias("left_chunk_id"), F.when(a < b, x["other"]).otherwise(x["segment"]).alias("right_chunk_id"), x["pair_score"].alias("pair_score"))).alias("evidence"),
    )


def refresh_node(links: DataFrame, candidates: DataFrame, node: str) -> DataFrame:
    """The links after one node was refreshed: its old ones go, its own choice comes."""
    kept = links.where((F.col("left_node_id") != node) & (F.col("right_node_id") != node))
    return kept.unionByName(_canonical(candidates.where(F.col("node").cast("string") == node)))


def degrees(links: DataFrame, left: str = "left_node_id", right: str = "right_node_id") -> DataFrame:
    """(node_id, relation_count)."""
    ends = links.select(F.explode(F.array(left, right)).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("relation_count"))


def one_hop(links: DataFrame, anchors: DataFrame, left: str = "left_node_id", right: str = "right_node_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, links): the anchors(node_id) with their neighbours, and all links between these nodes."""
    a = anchors.select("node_id").distinct()
    near = links.select(F.col(left).alias("a"), F.col(right).alias("b"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = a.unionByName(both.join(a.withColumnRenamed("node_id", "a"), "a", "left_semi").select(F.col("b").alias("node_id"))).distinct()
    inside = links.join(nodes.withColumnRenamed("node_id", left), left, "left_semi").join(nodes.withColumnRenamed("node_id", right), right, "left_semi")
    return nodes, inside


def visible_graph(nodes: DataFrame, links: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Links whose pair of kinds is chosen (such as 'document-rule', kinds in order), and the nodes that they touch."""
    k = nodes.select("node_id", "node_kind")
    rows = links.join(k.select(F.col("node_id").alias("left_node_id"), F.col("node_kind").alias("ka")), "left_node_id").join(k.select(F.col("node_id").alias("right_node_id"), F.col("node_kind").alias("kb")), "right_node_id")
    shown = rows.where(F.concat_ws("-", F.least("ka", "kb"), F.greatest("ka", "kb")).isin(kinds)).drop("ka", "kb")
    return nodes.join(degrees(shown).select("node_id"), "node_id", "left_semi"), shown


def graph_view(nodes: DataFrame, links: DataFrame, documents: DataFrame, term: str | None = None, settings=DEFAULTS) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes with relation_count, links, truncated) for a repository's graph under its caps.

    nodes(node_id, node_kind, document_id, ...), links with semantic_score, documents(document_id, title). Links
    count when a chosen document is at one end and a chosen document or any rule at the other; rules come in
    over one hop.
    """
    from folioforge.functions.text import like_term

    docs = documents.where(F.col("title").ilike(like_term(term))) if term else documents
    chosen = docs.orderBy("title", "document_id").limit(settings.graph_documents + 1)
    many_docs = chosen.count() > settings.graph_documents
    chosen = chosen.orderBy("title", "document_id").limit(settings.graph_documents)
    anchors = nodes.where("node_kind = 'document'").join(chosen.select("document_id"), "document_id", "left_semi").select("node_id")
    allowed = anchors.unionByName(nodes.where("node_kind = 'rule'").select("node_id"))
    ends = links.join(allowed.withColumnRenamed("node_id", "left_node_id"), "left_node_id", "left_semi").join(allowed.withColumnRenamed("node_id", "right_node_id"), "right_node_id", "left_semi")
    touch = anchors.withColumn("_t", F.lit(1))
    eligible = ends.join(touch.select(F.col("node_id").alias("left_node_id"), F.col("_t").alias("l")), "left_node_id", "left").join(touch.select(F.col("node_id").alias("right_node_id"), F.col("_t").alias("r")), "right_node_id", "left")
    eligible = eligible.where("l IS NOT NULL OR r IS NOT NULL").drop("l", "r")
    many_links = eligible.limit(settings.graph_links + 1).count() > settings.graph_links
    shown = eligible.orderBy(F.col("semantic_score").desc(), "link_id").limit(settings.graph_links)
    touched = anchors.unionByName(shown.select(F.explode(F.array("left_node_id", "right_node_id")).alias("node_id"))).distinct()
    many_nodes = touched.count() > settings.graph_nodes
    counted = nodes.join(touched, "node_id", "left_semi").join(degrees(shown), "node_id", "left").withColumn("relation_count", F.coalesce("relation_count", F.lit(0)))
    kept = counted.orderBy(F.col("relation_count").desc(), "node_id").limit(settings.graph_nodes)
    ids = kept.select("node_id")
    inside = shown.join(ids.withColumnRenamed("node_id", "left_node_id"), "left_node_id", "left_semi").join(ids.withColumnRenamed("node_id", "right_node_id"), "right_node_id", "left_semi")
    return kept, inside, many_docs or many_links or many_nodes


def grid_layout(nodes: DataFrame, width: float = 260.0, height: float = 120.0) -> DataFrame:
    """Nodes without links on a grid near to a square: x and y by position."""
    size = nodes.agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count(F.lit(1))))).alias("_c"))
    rows = numbered(nodes, ["node_id"], "_i").crossJoin(F.broadcast(size))  # one number
    return rows.withColumn("x", (F.col("_i") % F.col("_c")) * width).withColumn("y", F.floor(F.col("_i") / F.col("_c")) * height).drop("_i", "_c")
