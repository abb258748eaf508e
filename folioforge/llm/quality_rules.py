"""Quality rules with risk-controlled thresholds.

Every whole text gives a handful of counts. Four rules compare a ratio with a cutoff: symbols per word,
exclamation marks per word, the share of repeated lines, the share of words in repeated 3-word windows. For
each stratum (lang) and rule a fixed ladder of cutoffs is tried from lax to strict on the labelled good
documents of that stratum: a step is taken while the exact binomial tail P(Bin(n, ALPHA / rules) <= rejected)
is at most DELTA / (strata * rules). Going down a ladder in a fixed order needs no further correction
(fixed-sequence testing); the Bonferroni share covers strata and rules. So with probability 1 - DELTA no
stratum loses more than ALPHA of its good documents to the rules together. A stratum with too few labels
for any step keeps its documents.

Counts are made row by row; 3-word windows are compared by 64-bit hashes inside a row, sorted only where a
text has a repeated window. What is shuffled are numbers, joined with labels by id; the table of cutoffs has
one row per stratum.

Nulls: a null text has no words and fails the base rule; a null lang is a stratum of its own; a null doc_id
has no label. A doc_id that is labelled twice counts as good only if all its labels say so. Repeated rows are
judged alike; empty tables give empty results; extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

ALPHA, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rule -> (ratio as SQL over the counts, cutoffs from lax to strict); a text is rejected above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1)),
    "bangs": ("n_bangs / n_words", (1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1)),
    "dup_lines": ("n_dup_lines / n_lines", (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
}


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and n_words, word_chars, n_symbols, n_bangs, n_lines, n_dup_lines, n_repeat_words (long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.translate(text, "\t\n\x0b\f\r", " " * 5)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    rows = docs.select(
        *keep,
        F.array_remove(F.split(blank, " "), "").alias("_w"),
        F.length(F.translate(blank, " ", "")).cast("long").alias("word_chars"),
        _without(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        _without(text, "!").cast("long").alias("n_bangs"),
        lines.alias("_lines"),
    )
    rows = rows.select(
        *keep, "_w", "word_chars", "n_symbols", "n_bangs", F.size("_w").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(_w) >= 3 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) ELSE array() END").alias("_h"),
    ).drop("_w")
    # Places of windows in the order of their hashes, only where some window occurs twice.
    rows = rows.withColumn("_p", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN array_sort(transform(_h, (x, i) -> struct(x, i))) ELSE array() END")).drop("_h")
    twice = "(j > 0 AND _p[greatest(j - 1, 0)].x = p.x) OR (j + 1 < size(_p) AND _p[least(j + 1, size(_p) - 1)].x = p.x)"
    rows = rows.withColumn("_at", F.expr(f"sort_array(filter(transform(_p, (p, j) -> CASE WHEN {twice} THEN p.i END), i -> i IS NOT NULL))")).drop("_p")
    covered = "aggregate(_at, struct(-3 AS last, 0L AS total), (a, i) -> struct(i AS last, a.total + least(3, i - a.last) AS total), a -> a.total)"
    return rows.withColumn("n_repeat_words", F.expr(covered)).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def _ratio(rule: str) -> Column:
    return F.coalesce(F.try_divide(*[F.col(x.strip()).cast("double") for x in RULES[rule][0].split("/")]), F.lit(0.0))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly in logarithms; 1 where k is above the mean, which no test accepts."""
    q = F.lit(1.0 - p)
    start = n * F.log(q)
    more = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(start.alias("term"), start.alias("total")),
        lambda a, i: F.struct(
            (a["term"] + F.log((n - i + 1) / i * F.lit(p) / q)).alias("term"),
            (
                F.greatest(a["total"], a["term"] + F.log((n - i + 1) / i * F.lit(p) / q))
                + F.log1p(F.exp(-F.abs(a["total"] - (a["term"] + F.log((n - i + 1) / i * F.lit(p) / q)))))
            ).alias("total"),
        ),
        lambda a: F.exp(a["total"]),
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(more)


def cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cut_<rule>...): the cutoffs chosen, null where no step of the ladder could be taken.

    `counts` should be stored: filters on it would otherwise be pushed into the counting and repeat it word by word.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good")).where("good = 1")
    rows = counts.where(~base_failed()).join(good.select("doc_id"), "doc_id", "left_semi")
    rejected = [F.count_if(_ratio(r) > c).alias(f"{r}_{j}") for r, (_, ladder) in RULES.items() for j, c in enumerate(ladder)]
    per = rows.groupBy(F.col("lang").alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *rejected)
    per = per.crossJoin(F.broadcast(per.agg(F.count(F.lit(1)).alias("strata"))))  # one row by one number
    level = F.lit(delta) / (F.col("strata") * len(RULES))
    for rule, (_, ladder) in RULES.items():
        passed = F.lit(True)
        cut = F.lit(None).cast("double")
        for j, c in enumerate(ladder):
            passed = passed & (F.col(f"ok_{rule}_{j}"))
            cut = F.when(passed, F.lit(c)).otherwise(cut)
            per = per.withColumn(f"ok_{rule}_{j}", binomial_tail(F.col("n"), F.col(f"{rule}_{j}"), alpha / len(RULES)) <= level)
        per = per.withColumn(f"cut_{rule}", cut)
    return per.select("stratum", *[f"cut_{r}" for r in RULES])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row."""
    counts = materialise(base_counts(docs, "doc_id", "lang"), "rule-counts")
    cuts = materialise(cutoffs(counts, labels), "rule-cutoffs")
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(_ratio(rule) > F.col(f"cut_{rule}"), F.lit(False))
    rows = counts.join(cuts, counts["lang"].eqNullSafe(cuts["stratum"]), "left").withColumn("base_failed", base_failed())
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept")
    )
