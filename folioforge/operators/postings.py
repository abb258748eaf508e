"""A stored inverted index: postings in blocks, kept up to date, and top-k searches that skip blocks.

The chunks are dealt to spans by a hash of their keys, some SPAN chunks each. A block holds the postings of one term in one
span, their number, and the largest weight that one of them adds to a score apart from the term's rarity. Blocks lie in folders by a
hash of the term, so a search reads the folders of its terms; how many chunks hold a term is the sum over its blocks.

A search adds up the largest weights by span, without reading postings. It scores the spans that promise most, which gives the k-th
best score a floor, and then only those spans whose sum reaches the floor. Scores are those of `retrieval.bm25_search`.

Blocks are made from the texts, of which the index keeps the terms with their numbers: what is shuffled are compact fragments, by folder.
An update makes the blocks of the old and new terms of its chunks anew, from the texts of their spans, and writes them, all in one
commit of the repository that holds the index; the rest stays as it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.config import DEFAULTS, Settings
from folioforge.operators.retrieval import tokens
from folioforge.session import stored
from folioforge.sources.commits import Repository, Transaction, Version

FOLDERS, SPAN, FIRST = 64, 128, 16
#: Words of the texts whose blocks one task makes; most words or postings of some texts that are worked on at once.
TOKENS, BATCH = 1 << 20, 1 << 20
_BLOCKS = "bucket int, term string, span int, n long, top double, docs array<struct<key: string, tf: long, len: int>>"
_TEXTS = "span int, key string, len int, terms array<struct<term: string, tf: long>>"
_FACTS = "name string, value double"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _weight(tf, length, s: Settings):
    """Of columns or of arrays of numbers."""
    return tf * (s.bm25_k1 + 1) / (tf + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * length / s.bm25_avg_len))


def _span(key: Column, spans: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(spans)).cast("int")


def _keys(chunks: DataFrame, key: str) -> DataFrame:
    """(key, times): how often each key comes."""
    return chunks.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("times"))


def _pieces(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Some rows each, whose lists in column `at` have at most `most` items together, or one row that has more."""
    ends, begin = np.cumsum(batch.column(at).value_lengths().to_numpy()), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, most + (ends[begin - 1] if begin else 0), "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _counted(chunks: DataFrame, spans: int, key: str, text: str, single: bool = False) -> DataFrame:
    """(span, key, len, terms) of each chunk; of chunks that share a key the greatest text stays. Where none do (`single`), no text is shuffled."""
    rows = chunks.select(F.col(key).cast("string").alias("key"), F.coalesce(text, F.lit("")).alias("_text"))
    if not single:
        rows = rows.groupBy("key").agg(F.max("_text").alias("_text"))
    rows = rows.select(_span(F.col("key"), spans).alias("span"), "key", tokens(F.col("_text")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, 2, BATCH):
                yield counted(piece)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, words = batch.num_rows, batch.column(2)
        lengths, coded = words.value_lengths().to_numpy(), words.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        size = max(1, len(order))
        found, tf = np.unique(np.repeat(np.arange(n), lengths) * size + place[coded.indices.to_numpy()], return_counts=True)
        terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(order[found % size])), pa.array(tf)], names=["term", "tf"])
        ends = pa.array(np.searchsorted(found // size, np.arange(n + 1)).astype(np.int32))
        columns = [batch.column(0), batch.column(1), pa.array(lengths), pa.ListArray.from_arrays(ends, terms)]
        return pa.RecordBatch.from_arrays(columns, names=["span", "key", "len", "terms"])

    return rows.mapInArrow(run, _TEXTS)


def _postings(texts: DataFrame) -> DataFrame:
    """(part, terms, counts, at, tf, keys, spans, lens, kinds): the postings of texts(span, key, len, terms) by part, where blocks are made.

    A part is a bucket, or a share of its spans, with some TOKENS words; it comes in fragments, one a batch of texts. A fragment names its
    terms and its texts once, and has the postings by term, as so many a term, the places of their texts, and their numbers. `kind`, where
    texts have it, is 0 of texts that stay, 1 of those that come and 2 of those that go.
    """
    places = max(1, -(-(texts.agg(F.sum("len")).first()[0] or 0) // TOKENS))
    shares = -(-places // FOLDERS)
    kind = F.col("kind") if "kind" in texts.columns else F.lit(0)
    rows = texts.select("span", "key", "len", kind.cast("int").alias("kind"), "terms", F.transform("terms", lambda t: _bucket(t["term"])).alias("buckets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, 4, BATCH):
                yield fragments(piece)

    def fragments(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, flat = batch.num_rows, batch.column(4).flatten()
        span = batch.column(0).to_numpy()
        text = np.repeat(np.arange(n), batch.column(4).value_lengths().to_numpy())
        part = batch.column(5).flatten().to_numpy().astype(np.int64) * shares + span[text] % shares
        coded = flat.field("term").dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.lexsort((code, part))
        part, code, text, tf = part[order], code[order], text[order], flat.field("tf").to_numpy()[order]
        parts = np.unique(part)
        cut = lambda of: pa.array(np.append(np.searchsorted(of, parts), len(of)).astype(np.int32))
        first = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
        known, place = np.unique(part * n + text, return_inverse=True)
        held, mine = cut(known // n), pa.array(known % n)
        place = place - np.searchsorted(known // n, part)
        lists = lambda offsets, values: pa.ListArray.from_arrays(offsets, values)
        words, each, whole = cut(part[first]), np.diff(np.append(first, len(part))), cut(part)
        columns = [pa.array(parts), lists(words, coded.dictionary.take(pa.array(code[first]))), lists(words, pa.array(each.astype(np.int32)))]
        columns += [lists(whole, pa.array(x.astype(np.int32))) for x in (place, tf)]
        columns += [lists(held, batch.column(i).take(mine)) for i in (1, 0, 2, 3)]
        return pa.RecordBatch.from_arrays(columns, names=["part", "terms", "counts", "at", "tf", "keys", "spans", "lens", "kinds"])

    schema = "part long, terms array<string>, counts array<int>, at array<int>, tf array<int>, keys array<string>, spans array<int>, lens array<int>, kinds array<int>"
    found = rows.mapInArrow(run, schema).withColumn("terms", F.array_join("terms", " "))  # terms have no blanks, and one string is shorter
    return found.repartition(places, "part").sortWithinPartitions("part").withColumn("bucket", F.floor(F.col("part") / shares).cast("int"))


def _blocked(postings: DataFrame, settings: Settings, changed: bool = False) -> DataFrame:
    """Blocks of `_postings`, each of one term in one span; with `changed` only those of texts that come or go, which may be empty then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                here = batch.column("part")[i].as_py()
                if here != part and held:
                    yield blocks(held)
                    held = []
                part = here
                held.append(batch.slice(i, 1))
        if held:
            yield blocks(held)

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: pa.concat_arrays(rows.column(name).chunks)
        of = lambda name: column(name).flatten()
        coded = pc.split_pattern(column("terms"), " ").flatten().dictionary_encode()
        code = np.repeat(coded.indices.to_numpy(), of("counts").to_numpy())
        sizes = column("keys").value_lengths().to_numpy()
        text = of("at").to_numpy() + np.repeat(np.cumsum(sizes) - sizes, column("at").value_lengths().to_numpy())
        keys, tf, kind = of("keys"), of("tf").to_numpy().astype(np.int64), of("kinds").to_numpy()[text]
        span, length = of("spans").to_numpy()[text], of("lens").to_numpy()[text]
        rank = np.empty(len(keys), dtype=np.int64)
        rank[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
        order = np.lexsort((rank[text], span, code))
        text, tf, kind, span, length, code = (x[order] for x in (text, tf, kind, span, length, code))
        first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(span, prepend=-1) != 0))
        stays = kind < 2
        n = np.add.reduceat(stays, first, dtype=np.int64)
        top = np.maximum.reduceat(np.where(stays, _weight(tf, length, settings), 0.0), first)
        if changed:
            chosen = np.maximum.reduceat(kind, first) > 0
            stays &= np.repeat(chosen, np.diff(np.append(first, len(code))))
            first, n, top = first[chosen], n[chosen], top[chosen]
        docs = pa.StructArray.from_arrays([keys.take(pa.array(text[stays])), pa.array(tf[stays]), pa.array(length[stays])], names=["key", "tf", "len"])
        docs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), docs)
        columns = [pa.repeat(column("bucket")[0], len(first)), coded.dictionary.take(pa.array(code[first])), pa.array(span[first]), pa.array(n), pa.array(top), docs]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "term", "span", "n", "top", "docs"])

    return postings.mapInArrow(run, _BLOCKS)


@dataclass
class Index:
    """An index in a repository, as one version of it has it."""

    home: Repository
    version: Version
    name: str = "index"
    settings: Settings = DEFAULTS

    def _table(self, part: str) -> str:
        return f"{self.name}_{part}"

    @property
    def facts(self) -> dict[str, float]:
        return {r.name: r.value for r in self.version.read(self._table("facts")).collect()}  # a handful

    def _facts(self, chunks: float, spans: int) -> DataFrame:
        s = self.settings
        values = {"chunks": chunks, "spans": spans, "k1": s.bm25_k1, "b": s.bm25_b, "avg_len": s.bm25_avg_len}
        return self.home.spark.createDataFrame([(k, float(v)) for k, v in values.items()], _FACTS)

    def update(self, chunks: DataFrame, deleted: DataFrame | None = None, key: str = "chunk_id", text: str = "text") -> Index:
        """The index after chunks(key, text) came, new or in place of their old texts, and deleted(key) went."""
        facts = self.facts
        spans = int(facts["spans"])
        named = _keys(chunks, key)
        if deleted is not None:
            gone = deleted.select(F.col(key).cast("string").alias("key"), F.lit(0).cast("long").alias("times"))
            named = named.unionByName(gone).groupBy("key").agg(F.max("times").alias("times"))
        named = stored(named.withColumn("span", _span(F.col("key"), spans)), "index-named")
        touched = stored(named.select("span").distinct(), "index-touched")
        most, come = named.agg(F.max("times"), F.count_if(F.col("times") > 0)).first()
        before = self.version.read(self._table("texts"))
        same = (F.col("span") == F.col("_span")) & F.col("key").eqNullSafe(F.col("_key"))
        marked = named.select(F.col("span").alias("_span"), F.col("key").alias("_key"))
        old = stored(before.select("span", "key").join(marked, same, "left_semi").select(F.col("span").alias("_span"), F.col("key").alias("_key"), F.lit(2).alias("_kind")), "index-old")
        lost = old.count()
        # Texts that stay are joined to small tables only, where few are replaced.
        stay = before.join(touched, "span", "left_semi").join(old, same, "left").withColumn("kind", F.coalesce("_kind", F.lit(0))).drop("_span", "_key", "_kind")

        with self.home.begin(self.version) as change:
            change.upsert(self._table("texts"), _counted(chunks, spans, key, text, (most or 0) < 2), placed=True)
            texts = stay.unionByName(change.written(self._table("texts")).withColumn("kind", F.lit(1)))
            change.upsert(self._table("blocks"), _blocked(_postings(texts), self.settings, changed=True).where("n > 0"), placed=True)
            if lost:  # else no block can have become empty
                texts = texts.join(stored(old.select(F.col("_span").alias("span")).distinct(), "index-lost"), "span", "left_semi")
                change.delete(self._table("blocks"), _blocked(_postings(texts), self.settings, changed=True).where("n = 0"))
            change.delete(self._table("texts"), named.where("times = 0").select("span", "key"))
            change.upsert(self._table("facts"), self._facts(facts["chunks"] - lost + come, spans))
        return Index(self.home, self.home.at(change.parent.number + 1), self.name, self.settings)

    def _terms(self, query: str) -> list[tuple[str, int]]:
        rows = self.home.spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("term"))
        return [tuple(r) for r in rows.select("term", _bucket(F.col("term"))).collect()]  # the query's own terms

    def _read(self, terms: list[tuple[str, int]]) -> DataFrame:
        return self.version.read(self._table("blocks"), F.col("bucket").isin(sorted({b for _, b in terms})) & F.col("term").isin([t for t, _ in terms]))

    def _scored(self, terms: list[tuple[str, int]], idf: Column, spans: DataFrame) -> DataFrame:
        hits = self._read(terms).join(spans.select("span"), "span", "left_semi").select("term", F.inline("docs"))
        return hits.groupBy("key").agg(F.sum(idf * _weight(F.col("tf"), F.col("len"), self.settings)).alias("score"))

    def plan(self, query: str) -> tuple[list[tuple[str, int]], Column | None, DataFrame | None]:
        """The query's terms, their rarity, and (span, bound): the most that a chunk of each span can score."""
        facts = self.facts
        if (facts["k1"], facts["b"], facts["avg_len"]) != (self.settings.bm25_k1, self.settings.bm25_b, self.settings.bm25_avg_len):
            raise ValueError("the index was built with other settings")
        terms = self._terms(query)
        if not terms:
            return terms, None, None
        blocks = self._read(terms).select("term", "span", "n", "top")
        found = {r.term: r.n for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term
        if not found:
            return terms, None, None
        n = facts["chunks"]
        rare = F.create_map(*[x for t, df in found.items() for x in (F.lit(t), F.log((F.lit(n) - F.lit(df) + 0.5) / (F.lit(df) + 0.5) + 1))])
        idf = rare[F.col("term")]
        return [t for t in terms if t[0] in found], idf, blocks.groupBy("span").agg(F.sum(idf * F.col("top")).alias("bound"))

    def search(self, query: str, k: int = 10) -> DataFrame:
        """(key, score) of the k best chunks, the smaller key first of equals."""
        terms, idf, spans = self.plan(query)
        if idf is None or k < 1:
            return self.home.spark.createDataFrame([], "key string, score double")
        order = [F.round("score", 9).desc(), F.col("key")]
        spans = stored(spans, "index-spans")
        best = self._scored(terms, idf, spans.orderBy(F.desc("bound"), "span").limit(FIRST)).orderBy(*order).limit(k).collect()  # k rows
        floor = best[-1].score if len(best) == k else 0.0
        return self._scored(terms, idf, spans.where(F.col("bound") >= floor - 1e-6)).orderBy(*order).limit(k)


def build(home: Repository, chunks: DataFrame, key: str = "chunk_id", text: str = "text", name: str = "index", settings: Settings = DEFAULTS, span: int = SPAN) -> Index:
    """A new index of chunks(key, text), or one in place of an old one; spans are as many as hold `span` chunks each."""
    n, most = _keys(chunks, key).agg(F.count(F.lit(1)), F.max("times")).first()
    spans = max(1, -(-n // span))
    index = Index(home, home.at(), name, settings)

    def work(change: Transaction) -> None:
        for part, schema, keys, split, order in (("blocks", _BLOCKS, ["bucket", "term", "span"], "bucket", "term"), ("texts", _TEXTS, ["span", "key"], None, None), ("facts", _FACTS, ["name"], None, None)):
            if index._table(part) not in change.tables:
                change.create(index._table(part), StructType.fromDDL(schema), keys, split=split, order=order)
        change.rewrite(index._table("texts"), _counted(chunks, spans, key, text, (most or 0) < 2), placed=True)
        change.rewrite(index._table("blocks"), _blocked(_postings(change.written(index._table("texts"))), settings), placed=True)
        change.rewrite(index._table("facts"), index._facts(n, spans))

    return Index(home, home.change(work), name, settings)
