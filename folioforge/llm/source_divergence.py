"""Source divergence audit: how far the words of each source of a language are from those of the others.

Terms are runs of ASCII letters and characters beyond ASCII, of which only A-Z are lower-cased. A language keeps the
terms that occur in at least MIN_DOCS of its documents. Each source of a language, and the language, gives a kept term
the share p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), where N is the sum of its counts and V the number of kept
terms; the divergence of two sources is the sum of the absolute differences of p over all kept terms, in whole numbers.

Count columns are deduplicated: terms of a language with the same sparse vector of counts by source have the same shares
everywhere, so each pair of sources that such a vector holds is evaluated once per distinct vector and multiplied by the
number of its terms. Sources that a vector leaves out have the count 0, whose share is one number per source: they enter by
a closed form over all terms, corrected once per different count of the other source. Then the original terms are ranked.

Words are counted where the texts are and combined there, in tables of at most HELD entries, before anything is shuffled;
a text of any length is read in pieces. Shares are taken in decimals, so that no count is too large for them.

Nulls: null text, lang and source are the empty string. A source without terms still has its row in every pair; where a
language keeps no term all divergences are 0. Repeated rows count as often as they occur. An empty table gives an empty
result; extra columns do no harm.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

MIN_DOCS, SCALE, PRIOR, TOP_TERMS = 30, 1_000_000_000, 5, 50
#: Entries of counts that a task holds before it hands them on; bytes of a text that are read at once.
HELD, PIECE = 300_000, 1 << 20
_TERM, _GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


def pieces(text: bytes) -> Iterator[bytes]:
    """The text, cut between terms."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), combined as far as memory goes."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 20_000):
                some = terms[at : at + 20_000]
                columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    since = 0
    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(n), set()
            for piece in pieces(text.as_buffer().to_pybytes().lower()):  # of bytes, only A-Z change
                words = _TERM.findall(piece)
                n.update(words)
                seen.update(words)
            docs.update(seen)
            since += len(n) - before
            if since >= HELD:
                yield from given()
                since = 0
    yield from given()


def term_vectors(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, vector): the kept terms with their counts by source, sources in order."""
    empty = F.lit("")
    rows = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    each = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return terms.where(F.col("docs") >= min_docs).select("lang", "term", "total", "vector")


def share(count: Column, total: Column, terms: Column) -> Column:
    """The share of a count, exact; null where no term is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    parts = F.lit(SCALE).cast("decimal(10,0)") * wide(count + PRIOR)
    return (F.call_function("div", parts, F.nullif(wide(total + PRIOR * terms), F.lit(0).cast("decimal(20,0)"))) + 1).cast("long")


def _sources(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, v, lang_n, none): every source with its sum of counts and its share of the count 0, beside those of its language."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    own = kept.select("lang", F.inline("vector")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    rows = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    rows = rows.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "v", "lang_n")])
    return rows.withColumn("none", share(F.lit(0), F.col("n"), F.col("v")))


def _pairs(kept: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of every two sources of a language, both ways."""
    vectors = materialise(kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("times")).withColumn("id", F.monotonically_increasing_id()), "divergence-vectors")
    entries = vectors.select("lang", "id", "times", F.inline("vector").alias("source", "count")).join(sources, ["lang", "source"])
    entries = materialise(entries.select("lang", "source", "id", "times", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), "none"), "divergence-shares")
    # Both sources hold the term: once per distinct vector.
    whole = entries.groupBy("lang", "id", "times").agg(F.sort_array(F.collect_list(F.struct("source", "p", "none"))).alias("e"))
    two = whole.select("lang", "times", "e", F.posexplode("e").alias("i", "a")).select("lang", "times", "a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = gap("a.p", "b.p") - gap("a.p", "b.none") - gap("a.none", "b.p") + gap("a.none", "b.none")
    both = two.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.sum(both * F.col("times")).alias("value"))
    # One holds it, as if the other did not: once per share that a source gives.
    others = sources.select("lang", F.col("source").alias("item"), F.col("none").alias("other"), "v")
    ones = entries.groupBy("lang", "source", "p", "none").agg(F.sum("times").alias("times")).join(others, "lang").where("source != item")
    ones = ones.groupBy("lang", "source", "item").agg(F.sum((gap("p", "other") - gap("none", "other")) * F.col("times")).alias("value"))
    halves = both.unionByName(ones)
    # Neither holds it.
    neither = sources.select("lang", "source", "none").join(others, "lang").where("source != item").select("lang", "source", "item", F.coalesce(F.col("v") * gap("none", "other"), F.lit(0)).alias("value"))
    turned = halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    out = materialise(neither.unionByName(halves).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "divergence-pairs")
    release(vectors, entries)
    return out


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair` ranks the other sources of the language by divergence, all of them; part `term` the kept terms that the
    source uses more than its language does, by that difference, up to `top`. Ties are in order of the item's bytes.
    """
    kept = materialise(term_vectors(docs, min_docs), "divergence-terms")
    sources = materialise(_sources(docs, kept), "divergence-sources")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(kept, sources).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    used = kept.select("lang", F.col("term").alias("item"), "total", F.inline("vector").alias("source", "count")).join(sources, ["lang", "source"])
    used = used.withColumn("value", share(F.col("count"), F.col("n"), F.col("v")) - share(F.col("total"), F.col("lang_n"), F.col("v"))).where("value > 0").select("lang", "source", "item", "value")
    terms = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(names).unionByName(terms.select(names))
