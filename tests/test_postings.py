"""The stored index against scores taken from the texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioforge.config import Settings
from folioforge.operators import postings, retrieval
from folioforge.sources.commits import Repository


def texts(seed=2, n=300):
    r = random.Random(seed)
    words = [f"w{int(r.expovariate(0.08))}" for _ in range(4000)]
    return [(f"c{k}", " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for k in range(n)]


def plain(df):
    return [(r[0], round(r.score, 9)) for r in df.collect()]


def by_texts(spark, rows, query, k):
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    return plain(retrieval.bm25_search(retrieval.postings(chunks, query=query), len(rows), query, k))


def stored_rows(index, part):
    return sorted(map(str, index.version.read(f"index_{part}").collect()))


QUERIES = ["w1 w30", "w0 w1 w2 w3", "w77", "nothing here", "W5 w5, w9!", ""]


def test_searches_equal_scores_from_the_texts(spark, tmp_path):
    rows = texts()
    index = postings.build(Repository(spark, f"file://{tmp_path}/r"), spark.createDataFrame(rows, "chunk_id string, text string").repartition(5), span=4)
    for query in QUERIES:
        for k in (1, 10, 500):
            assert plain(index.search(query, k)) == (by_texts(spark, rows, query, k) if re.search(r"\w", query) else [])
    assert index.facts["spans"] == 75


def test_blocks_are_skipped_and_only_folders_of_the_terms_are_read(spark, tmp_path, monkeypatch):
    rows = texts(n=400) + [(f"x{k}", "rare " * 40) for k in range(3)]
    index = postings.build(Repository(spark, f"file://{tmp_path}/r"), spark.createDataFrame(rows, "chunk_id string, text string"), span=4)
    seen = []
    real = postings.Index._scored
    monkeypatch.setattr(postings.Index, "_scored", lambda self, t, idf, spans: seen.append(spans.count()) or real(self, t, idf, spans))
    monkeypatch.setattr(postings, "FIRST", 3)
    assert plain(index.search("rare w1", 3)) == by_texts(spark, rows, "rare w1", 3)
    spans = index.plan("rare w1")[2].count()
    assert seen[1] <= 10 and spans > 60
    plan = index._read(index._terms("rare"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    files = index._read(index._terms("rare")).select(F.input_file_name()).distinct().count()
    assert files == 1 and "EqualTo(term,rare)" in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_updates_equal_a_rebuild(spark, tmp_path, seed):
    r = random.Random(seed)
    now = dict(texts(seed, 120))
    home = Repository(spark, f"file://{tmp_path}/r")
    index = postings.build(home, spark.createDataFrame(list(now.items()), "chunk_id string, text string"), span=30)
    for step in range(3):
        changed = {f"c{r.randint(0, 150)}": f"new{step} w{r.randint(0, 9)} w1" if r.random() < 0.9 else "" for _ in range(8)}
        gone = [k for k in r.sample(sorted(now), 5) if k not in changed] + ["unknown"]
        now = {k: v for k, v in (now | changed).items() if k not in gone}
        index = index.update(spark.createDataFrame(list(changed.items()), "chunk_id string, text string"), spark.createDataFrame([(k,) for k in gone], "chunk_id string"))
    spans = int(index.facts["spans"])
    fresh = postings.Index(home, index.version)
    whole = postings._counted(spark.createDataFrame(list(now.items()), "chunk_id string, text string"), spans, "chunk_id", "text")
    assert stored_rows(fresh, "texts") == sorted(map(str, whole.collect()))
    assert stored_rows(fresh, "blocks") == sorted(map(str, postings._blocked(postings._postings(whole), index.settings).collect()))
    assert index.facts["chunks"] == len(now)
    assert plain(index.search("w1 new2", 20)) == by_texts(spark, list(now.items()), "w1 new2", 20)


def test_an_update_writes_in_proportion(spark, tmp_path):
    home = Repository(spark, f"file://{tmp_path}/r")
    chunks = spark.range(4000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(3000))))).alias("text"))
    index = postings.build(home, chunks)
    index = index.update(spark.createDataFrame([("c7", "w1 w2 w3 fresh")], "chunk_id string, text string"))
    base, *more = index.version.layers("index_blocks")
    written = sum(index.version._files("index_blocks", layer, ["bucket", "term", "span"]).count() for layer in more)
    assert written <= 64  # blocks of the old and new terms of one chunk: 60 and 4
    assert sum(home.size("index_blocks", layer) for layer in more) < home.size("index_blocks", base) / 10  # mostly the feet of the files
    assert index.search("fresh", 3).first().key == "c7"


def test_settings_are_those_of_the_index(spark, tmp_path):
    index = postings.build(Repository(spark, f"file://{tmp_path}/r"), spark.createDataFrame([("a", "b")], "chunk_id string, text string"))
    with pytest.raises(ValueError, match="settings"):
        postings.Index(index.home, index.version, settings=Settings(bm25_b=0.1)).search("b")
