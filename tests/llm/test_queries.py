"""The registered queries and the pipeline on the smallest tables, against SQL and plain versions."""

import collections
import hashlib

import duckdb
import pytest
import tiktoken

import corpus_pipeline
from folioforge.llm import byte_bpe, queries
from folioforge.llm.common import table

from . import brute


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r.doc_id, r.text, r.source) for r in table(spark, sf, "documents").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, expected = queries.queries()[name](spark, sf).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert names == sorted(expected.columns)
    plain = lambda f: sorted(tuple(map(str, r)) for r in f[names].itertuples(index=False))
    assert plain(got) == plain(expected)


def test_op1(spark, sf, texts):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_suffix_dedup(spark, sf).collect()}
    assert got == {doc_id: row for (doc_id, _), row in brute.strip([t[:2] for t in texts]).items()}


def test_op2(spark, sf, texts):
    path, pattern = byte_bpe.installed()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in queries.op2_byte_bpe(spark, sf).collect()}
    for doc_id, text, _ in texts:
        ids = own.encode_ordinary(text)
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_op3(spark, sf, texts):
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op3_jaccard_join(spark, sf).collect()}
    assert got == dict(zip([t[0] for t in texts], brute.near([t[:2] for t in texts]), strict=True))


def test_op7(spark, sf, texts):
    sizes = collections.Counter()
    for _, text, source in texts:
        sizes[source] += len(brute.WORD.findall(text))
    target, source, taken = brute.targets(sizes), {t[0]: t[2] for t in texts}, collections.Counter()
    largest = collections.Counter()
    for r in queries.op7_source_mixing(spark, sf).collect():
        assert r.target == pytest.approx(target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)


def test_pipeline_stage_by_stage(spark, sf):
    docs = table(spark, sf, "documents")
    names, rows = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, sf)
        if name == "byte_bpe":
            assert collections.Counter(r.doc_id for r in docs.collect()) == collections.Counter(i for i, _ in before)
            break
        assert docs.columns == names
        docs = docs.cache()
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert rows and set(rows) <= set(before)
        if name == "toxicity":
            bad = {r.doc_id for r in queries.op8_toxicity(spark, sf).where("predicted = 1").collect()}
            assert sorted(rows) == sorted(r for r in before if r[0] not in bad)
        elif name == "exact_dedup":
            assert sorted(r[0] for r in rows) == sorted({k for k, *_ in brute.copies(before)})
        elif name == "near_dedup":
            assert sorted(r[0] for r in rows) == sorted({c for c, _ in brute.near(before)})
        elif name == "mixing":
            assert max(collections.Counter(r[0] for r in rows).values()) <= 2
    assert corpus_pipeline.run(spark, sf).count() == len(rows)


def test_pipeline_on_odd_and_empty_tables(spark, sf, docs, rows, empty):
    for given, n in ((docs, len(rows)), (empty, 0)):
        names, now = given.columns, given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == names, name
            now = spark.createDataFrame(now.collect(), now.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
        assert len(last) == now.count() and bool(last) == bool(n)
