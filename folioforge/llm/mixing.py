"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of words: a budget of 150 % of all words, shared by weight, where no source gets
more than twice its own words and what is cut off is shared again by weight, until none is above. A round of
sharing is one aggregate over the table of sources, and weights go by the source's place in a sorted range, so
no task holds all sources.

A source takes complete epochs of all its documents first. For the rest every document draws an exponential
key -ln(u) / q, where q is its quality weight and u comes from a hash of its id, its text and its number among rows
that are equal in both, so reruns agree; in key order documents are taken until the sum of their words comes nearest to the rest. Keys are put into BINS bins by a
monotone function; per-bin sums (combined before the shuffle) tell in which bin the sum crosses the rest. That
bin is cut into BINS again while more than FEW rows lie in it, and only the rows of the last bin of each source are
put in order. No source, however hot, is sorted as a whole. The outcome of a source is one cut (key, id), so the
final decision is taken row by row.

Nulls: a null text has size 0 and is never taken; null sources form one source, which comes last. Rows that share a
doc_id, or have none, draw keys of their own, and so do rows that repeat a doc_id and text in one source, which are
interchangeable. A source without words has target 0. An empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, release

#: Share of all words that the mix takes, the cap in epochs, and the weights dealt to the sources in order.
BUDGET, CAP, WEIGHTS = 1.5, 2.0, (3.0, 1.0, 2.0)
#: Bins into which the keys of a source are put, again and again; rows that are put in order by sorting; least width of a bin.
BINS, FEW, NARROW = 4096, 50_000, 2.0**-48
SEED = 20_240_607


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: one less five times the share of symbol characters."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * symbols / n)


def text_code(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def exponential_key(doc_id: Column, code: Column, nth: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight, where u in (0, 1) comes from 52 bits of a hash of seed, id, text and number among equal rows."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), code, nth.cast("string")).cast("binary"))
    u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / weight


def _ranked(totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources with `rank`: their place by code point from 0, null last; and what it reads. Sorted ranges are counted and numbered."""
    ranges = materialise(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).select("_range", "_before")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("_i", inside).join(F.broadcast(before), "_range").withColumn("rank", F.col("_before") + F.col("_i")).drop("_range", "_i", "_before"), ranges


def source_targets(sizes: DataFrame, budget: float = BUDGET, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    array = F.array(*[F.lit(w) for w in weights])
    rows, ranges = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    rows = rows.withColumn("weight", F.element_at(array, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(cap))
    rows = materialise(rows.select("source", "source_size", "weight", "cap"), "mix-sources")
    release(ranges)
    # Sources at their caps leave the rest to the others, whose share a unit of weight, the level, can only rise.
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("cap") if capped >= 0 else F.lit(False)
        got = rows.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("cap"))).alias("caps"), F.sum(F.when(~above, F.col("weight"))).alias("weights")).first()
        if got.n == capped or not got.weights:
            break
        capped, level = got.n, (total * budget - (got.caps or 0.0)) / got.weights
    level = level if got.weights else float("inf")
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).cast("double").alias("target"))


def _place(key: Column) -> Column:
    """Keys from 0 on to [0, 1), in their order."""
    return key / (key + 1)


_SAME = ["doc_id", "code", "source"]


def _same(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on the columns of equal rows, nulls too; those of `b` go."""
    b = b.select(*[F.col(c).alias(f"_{c}") if c in _SAME else F.col(c) for c in b.columns])
    on = F.col("code") == F.col("_code")
    for c in ("doc_id", "source"):
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, on, how).drop(*[f"_{c}" for c in _SAME])


def repeated_rows(rows: DataFrame) -> DataFrame:
    """doc_id, code, source of the rows that occur more than once."""
    return rows.groupBy(*_SAME).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*_SAME)


def numbered_copies(rows: DataFrame) -> DataFrame:
    """`rows` (with `at`, increasing within a part file) with `nth`, the number among equal rows from 0.

    Equal rows are numbered part by part, and the parts by sums of counts, so no task holds a whole group.
    """
    again = materialise(repeated_rows(rows), "mix-repeated")
    if again.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    part = F.shiftright("at", 33)
    copies = _same(rows, again, "left_semi").withColumn("part", part)
    counts = copies.groupBy(*_SAME, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*_SAME).orderBy("part")) - F.col("n")
    counts = counts.select(*_SAME, F.col("part").alias("_part"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*_SAME, "part").orderBy("at")) - 1
    placed = _same(copies.withColumn("_i", inside), counts, "inner").where("part = _part")
    return _same(rows, again, "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(placed.withColumn("nth", F.col("_before") + F.col("_i")).select(*rows.columns, "nth"))


def thin_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, code, size, key) of every row."""
    rows = docs.select("doc_id", "source", text_code(F.col("text")).alias("code"), size_of(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("weight"))
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()), "mix-rows")
    key = exponential_key(F.col("doc_id"), F.col("code"), F.col("nth"), F.col("weight"))
    thin = materialise(numbered_copies(rows).select("doc_id", "source", "code", "size", key.alias("key"), (F.col("nth") > 0).alias("copy")), "mix-thin")
    release(rows)
    return thin


def _edges(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(e_source, low, width, before, rest): the bin of each source in which its sum of words crosses the rest."""
    edge = plan.select(F.col("source").alias("e_source"), F.lit(0.0).alias("low"), F.lit(1.0).alias("width"), F.lit(0).cast("long").alias("before"), "rest")
    while True:
        near = rows.join(edge, F.col("source").eqNullSafe(F.col("e_source"))).where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.col("width")))
        step = F.col("width") / BINS
        near = near.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("place") - F.col("low")) / step)))
        bins = near.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("low", "width", "before", "rest")])
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("before", F.col("before") + F.sum("words").over(upto) - F.col("words"))
        found = bins.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        after = materialise(found.select(F.col("source").alias("e_source"), (F.col("low") + F.col("bin") * step).alias("low"), step.alias("width"), "before", "rest", "n"), "mix-edges")
        if hasattr(edge, "stored_at"):
            release(edge)
        edge = after
        most = edge.agg(F.max("n").alias("n"), F.max("width").alias("width")).first()
        # Equal keys of different ids are as good as impossible, so bins of the least width hold few rows.
        if not most.n or most.n <= FEW or most.width <= NARROW:
            return edge


def source_cuts(thin: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, cut): cut is the last (key, id) taken in the fractional epoch, or null."""
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = thin.where("size > 0").withColumn("place", _place(F.col("key")))
    edge = _edges(rows, plan)
    inside = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.col("width"))
    near = rows.join(edge, F.col("source").eqNullSafe(F.col("e_source"))).where(inside)
    # Rows of one place (a repeated document) are taken together; the last place whose middle lies within the rest is the cut.
    places = near.groupBy("source", "key", "doc_id").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    fine = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = places.withColumn("middle", F.col("before") + F.sum("words").over(fine) - F.col("words") / 2)
    cuts = places.groupBy("source").agg(F.max(F.when(F.col("middle") <= F.col("rest"), F.struct("key", "doc_id"))).alias("cut"), F.min("key").alias("first_key"))
    # All of the edge bin refused: the cut lies just before its first key.
    cuts = cuts.select(F.col("source").alias("c_source"), F.coalesce(F.col("cut.key"), F.col("first_key")).alias("cut_key"), F.col("cut.doc_id").alias("cut_id"), F.col("cut").isNotNull().alias("cut_in"))
    return plan.join(cuts, plan["source"].eqNullSafe(cuts["c_source"]), "left").drop("c_source")


def _times(key: Column, doc_id: Column) -> Column:
    """How often a document is taken, from the columns of its source's cut."""
    within = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & F.col("cut_in") & (doc_id.isNull() | F.coalesce(doc_id <= F.col("cut_id"), F.lit(False))))
    return F.col("epochs") + F.coalesce(within, F.lit(False)).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    thin = thin_rows(docs)
    cuts = materialise(source_cuts(thin, source_targets(thin)), "mix-cuts").withColumnRenamed("source", "m_source")
    joined = thin.join(cuts, thin["source"].eqNullSafe(cuts["m_source"]))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("key"), F.col("doc_id"))).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, with the columns it had."""
    names = docs.columns
    thin = thin_rows(docs)
    cuts = materialise(source_cuts(thin, source_targets(thin)), "mix-cuts").withColumnRenamed("source", "m_source")
    again = materialise(_repeats_taken(thin, cuts), "mix-again")
    whole = F.struct(*[docs[f"`{c}`"] for c in names]).alias("_doc")
    rows = docs.select(whole, F.col("doc_id").alias("doc_id"), "source", text_code(F.col("text")).alias("code"), size_of(F.col("text")).alias("_size"), quality_weight(F.col("text")).alias("_weight"))
    rows = rows.where("_size > 0")
    copies = None
    if not again.isEmpty():
        # Of rows that are equal in id, text and source one stands for all.
        met = _same(rows, again, "inner").groupBy(*_SAME).agg(F.first("_doc").alias("_doc"), F.first("_taken").alias("_times"))
        copies, rows = met.select("_doc", F.col("_times").cast("int").alias("_times")), _same(rows, again, "left_anti")
    joined = rows.join(cuts, F.col("_doc.source").eqNullSafe(F.col("m_source")))
    key = exponential_key(F.col("_doc.doc_id"), F.col("code"), F.lit(0), F.col("_weight"))
    taken = joined.select("_doc", _times(key, F.col("_doc.doc_id")).cast("int").alias("_times"))
    taken = taken if copies is None else taken.unionByName(copies)
    return taken.where("_times > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("_doc.*")


def _repeats_taken(thin: DataFrame, cuts: DataFrame) -> DataFrame:
    """(doc_id, code, source, _taken): how often the rows that repeat others are taken, all together."""
    again = thin.where("copy").select(*_SAME).distinct()
    rows = _same(thin.where("size > 0"), again, "left_semi")
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("m_source")))
    return rows.groupBy(*_SAME).agg(F.sum(_times(F.col("key"), F.col("doc_id"))).alias("_taken"))
