"""What the fourth review found: bytes that the stored index shuffles, searches that depended on the size of their input."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from folioforge.config import DEFAULTS
from folioforge.operators import nearest, postings, retrieval, semantic
from folioforge.plans import graph_plans
from folioforge.plans.common import SQL
from folioforge.sources.commits import Repository


def shuffled(spark, after):
    """Bytes that the stages after one have written to shuffles, and the last stage."""
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    stages = [found.apply(i) for i in range(found.size())]
    return sum(s.shuffleWriteBytes() for s in stages if s.stageId() > after), max([s.stageId() for s in stages], default=-1)


def test_building_and_updating_an_index_shuffles_few_bytes_a_posting(spark, tmp_path):
    """postings are shuffled once, in compact fragments by folder, and nothing else that grows with the text."""
    words = F.transform(F.sequence(F.lit(1), F.lit(120)), lambda i: F.conv(F.pmod(F.xxhash64("id", i), F.lit(40_000)).cast("string"), 10, 36))
    chunks = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat_ws(" ", words).alias("text"), (F.col("id") % 2).alias("half"))
    last = shuffled(spark, -1)[1]
    index = postings.build(Repository(spark, f"file://{tmp_path}/r"), chunks.where("half = 0")).update(chunks.where("half = 1"))
    assert index.facts["chunks"] == 3000
    assert shuffled(spark, last)[0] < 16 * 120 * (1500 + 3000)  # the build makes blocks of half of the texts, the update of all


def test_blocks_are_those_of_the_definition(spark, monkeypatch):
    """many parts, shares of buckets and small batches; texts that share a key, empty ones and a key that is null."""
    monkeypatch.setattr(postings, "TOKENS", 100)
    monkeypatch.setattr(postings, "BATCH", 50)
    r = random.Random(3)
    rows = [(f"c{r.randint(0, 250)}", " ".join(f"W{int(r.expovariate(0.05))} é" for _ in range(r.randint(0, 40)))) for _ in range(300)] + [(None, "w1 w1 ü"), ("", "w1"), ("e", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(4)
    texts = postings._counted(chunks, 9, "chunk_id", "text")
    best = {}
    for key, text in rows:
        best[key] = max(best.get(key, ""), text or "")
    tokens = {r.key: r.t for r in spark.createDataFrame(list(best.items()), "key string, text string").select("key", retrieval.tokens(F.col("text")).alias("t")).collect()}
    assert {r.key: (r.len, [tuple(t) for t in r.terms]) for r in texts.collect()} == {k: (len(t), sorted((w, t.count(w)) for w in set(t))) for k, t in tokens.items()}
    flat = texts.select("span", "key", "len", F.inline("terms"))
    top = F.max(postings._weight(F.col("tf"), F.col("len"), DEFAULTS))
    expected = flat.groupBy("term", "span").agg(F.count(F.lit(1)).alias("n"), top.alias("top"), F.sort_array(F.collect_list(F.struct("key", "tf", "len"))).alias("docs"))
    expected = expected.select(postings._bucket(F.col("term")).alias("bucket"), "term", "span", "n", "top", "docs")
    fragments = postings._postings(texts)
    assert fragments.select("part").distinct().count() > postings.FOLDERS
    assert sorted(map(str, postings._blocked(fragments, DEFAULTS).collect())) == sorted(map(str, expected.collect()))


def test_blocks_that_lose_their_last_text_are_deleted(spark, tmp_path):
    """of what an update replaces and deletes nothing stays in the blocks, a null key's text among it."""
    of = lambda rows: spark.createDataFrame(rows, "chunk_id string, text string")
    index = postings.build(Repository(spark, f"file://{tmp_path}/r"), of([("a", "once twice"), ("b", "twice only"), (None, "nobody"), ("d", "stays")]))
    index = index.update(of([("a", "new twice"), ("a", "older"), (None, "somebody")]), of([("b", ""), ("x", "")]).select("chunk_id"))
    blocks = {(r.term, tuple(map(tuple, r.docs)), r.n) for r in index.version.read("index_blocks").collect()}
    assert blocks == {("older", (("a", 1, 1),), 1), ("somebody", ((None, 1, 1),), 1), ("stays", (("d", 1, 1),), 1)}
    assert index.facts["chunks"] == 3


def clustered(n, size, seed):
    """Vectors around some centres, of which probes of a few lists find most."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 30, size))
    return np.repeat(centres, 30, axis=0) + 0.4 * r.normal(size=(n // 30 * 30, size))


def small_lists(monkeypatch):
    """Sizes from which on large sets were searched by lists."""
    monkeypatch.setattr(nearest, "WHOLE", 100, raising=False)
    monkeypatch.setattr(nearest, "LIST", 20, raising=False)


def test_a_search_is_exact_at_any_size(spark, monkeypatch):
    """no number of vectors makes a search one of lists, which meets only a share of the nearest."""
    small_lists(monkeypatch)
    m = clustered(1200, 16, 4)
    rows = spark.createDataFrame([(i, i // 10, v.tolist()) for i, v in enumerate(m)], "segment_id long, node_id long, embedding array<double>")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    s[np.arange(len(m))[:, None] // 10 == np.arange(len(m))[None, :] // 10] = -2
    order = np.argsort(-s, axis=1, kind="stable")[:, :30]
    expected = {(i, int(j)) for i in range(len(m)) for j in order[i] if s[i, j] >= 0.1875}
    found = semantic.similar_segments(rows.select(F.lit("o").alias("owner_id"), F.lit("m").alias("embedding_model"), "*"), 0.1875)
    assert {(r.segment, r.other) for r in found.collect()} == expected


def test_degrees_are_those_of_the_sql_at_any_size(spark, tmp_path, monkeypatch):
    """the links under the degrees come from an exact search."""
    small_lists(monkeypatch)
    m = np.random.default_rng(1).permutation(clustered(1200, 16, 4))
    rows = spark.createDataFrame([(i, i % 10, v.tolist()) for i, v in enumerate(m)], "vec_id long, label int, embedding array<double>")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = set(con.sql(SQL["node_degree_semantic"]).fetchall())
    assert {tuple(r) for r in graph_plans.node_degree_semantic(spark, str(tmp_path)).collect()} == expected
    assert len(expected) > 100
