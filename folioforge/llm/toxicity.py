"""Toxicity by a counterfactual-regularised classifier.

Features are the distinct lower-cased words of the whole text and their stems (the first STEMS letters), hashed
to 32 bits; the stems let inflected forms of a slur count together. For every labelled sentence
that mentions a group, a counterfactual is made by swapping each identity term for another of its set; the
loss is the log loss plus CF_PENALTY times the squared difference of the two scores' logits, so weights on
group names that do not carry the label are pulled together and neutral mentions stay harmless. Updates
follow the regularised leader with a strong L1 term: only words that keep their weight over many documents
survive, and long clean texts do not add up noise.

The classifier is fitted on at most MAX_TRAIN labelled rows, whose features (MAX_TRAIN_BYTES at most) meet in one
task of its own on an executor; the driver receives the non-zero weights only, whose number that sample bounds. Scoring streams over whole texts without
a shuffle. doc_id, lang, source and labels are never inputs of a score.

Nulls: a null text is an empty one and scores the intercept alone; a null doc_id falls into the fold of the
empty text. Without labels of both kinds nothing is learnt and every score is 0.0 (not toxic). Repeated rows get
equal scores; empty tables give empty results; extra columns do no harm.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of
from .linear import FTRL, labelled_sample, learn, sigmoid

#: Bounds on the labelled rows that training reads, and on the bytes of their features.
MAX_TRAIN, MAX_TRAIN_BYTES = 12_000, 1 << 27
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
EPOCHS, CF_PENALTY, L1 = 3, 1.0, 6.0
#: Lengths of stems.
STEMS = (4, 5, 6)
_WORD = re.compile(r"\w+")

#: Groups of people by kind, each kind a set of terms that may stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("american", "mexican", "chinese", "indian", "german", "french", "russian", "nigerian", "turkish", "polish"),
    ("immigrants", "refugees", "foreigners", "locals", "migrants"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("christen", "muslime", "juden"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("cristianos", "musulmanes", "judíos"),
)
_NEXT = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}


def words(text: str) -> set[str]:
    text = text.lower()
    return set(_WORD.findall(text)) if len(text) < 1 << 20 else {m[0] for m in _WORD.finditer(text)}


def counterfactual(found: set[str]) -> set[str] | None:
    """The words after each identity term has become the next of its kind; None without identity terms."""
    if not (terms := found & _NEXT.keys()):
        return None
    return (found - terms) | {_NEXT[t] for t in terms}


def codes(word: str) -> tuple[int, ...]:
    """The features of a word: itself and its stems, each with a mark of its length."""
    forms = [word, *[f"{word[:n]}~" for n in STEMS if len(word) >= n]]
    return tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in forms)


def features(found: set[str]) -> np.ndarray:
    return np.unique(np.fromiter((c for w in found for c in codes(w)), dtype=np.uint32))


def example(text: str) -> tuple[np.ndarray, np.ndarray | None]:
    """The features of a text and of its counterfactual."""
    found = words(text)
    other = counterfactual(found)
    return features(found), None if other is None else features(other)


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, penalty: float = CF_PENALTY, prune: bool = True) -> dict[int, float]:
    """Non-zero weights by feature; -1 is the intercept. Rows (text, label) in a fixed order."""
    return fit_features([(*example(text), int(label)) for text, label in rows], epochs, penalty, prune)


def fit_features(examples: list[tuple[np.ndarray, np.ndarray | None, int]], epochs: int = EPOCHS, penalty: float = CF_PENALTY, prune: bool = True) -> dict[int, float]:
    """The same from (features, those of the counterfactual, label). The list is used up.

    Features of one text without identity terms are left out from the start. Such a feature is updated once an
    epoch, with a gradient of at most 1 while its weight is 0, so its sum stays within the L1 threshold, its
    weight is 0 throughout and it changes nothing. (The other gradients, of features that a swap exchanges,
    have no such bound; texts with a counterfactual keep all their features.)
    """
    if not {0, 1} <= {y for *_, y in examples}:
        return {}
    least = 1 if prune and epochs <= L1 else 0
    kept = []
    for r in range(16):  # counted a sixteenth at a time, which keeps the copies small
        every = [x[x % 16 == r] for a, b, _ in examples for x in ((a,) if b is None else (a, a, b, b))]
        seen, counts = np.unique(np.concatenate(every), return_counts=True)
        kept.append(seen[counts > least])
    known = np.sort(np.concatenate(kept))

    def number(x: np.ndarray) -> np.ndarray:
        """Coordinates of the features that are known; 0 is the intercept."""
        at = np.searchsorted(known, x)
        at[at == len(known)] = 0
        return np.concatenate([[0], at[known[at] == x] + 1]).astype(np.int32) if len(known) else np.zeros(1, dtype=np.int32)

    for i, (x, other, y) in enumerate(examples):
        examples[i] = (number(x), None if other is None else number(other), y)
    model = FTRL(len(known) + 1, alpha=0.25, beta=1.0, l1=L1, l2=0.1)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            x, other, y = examples[i]
            w = model.weights(x)
            slope = sigmoid(w.sum()) - y
            if other is None:
                model.update(x, np.full(len(x), slope), w)
                continue
            at = np.union1d(x, other)
            w, inside, outside = model.weights(at), np.isin(at, x), np.isin(at, other)
            gap = w[inside].sum() - w[outside].sum()
            model.update(at, slope * inside + 2.0 * penalty * gap * (inside.astype(float) - outside), w)
    w = model.weights(slice(None))
    out = {int(f): float(v) for f, v in zip(known, w[1:], strict=True) if v}
    out[-1] = float(w[0])
    return out


def train(docs: DataFrame, labels: DataFrame) -> dict[int, float]:
    def fitted(rows: list[tuple[bytes, bytes | None, int]]) -> pa.RecordBatch:
        learnt = fit_features([(np.frombuffer(x, "<u4"), None if o is None else np.frombuffer(o, "<u4"), y) for x, o, y in rows])
        return pa.RecordBatch.from_arrays([pa.array(list(learnt), pa.int64()), pa.array(list(learnt.values()), pa.float64())], names=["feature", "weight"])

    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, MAX_TRAIN)
    return {r.feature: r.weight for r in learn(sample, lambda: example, fitted, "feature long, weight double", MAX_TRAIN_BYTES).collect()}


def score(docs: DataFrame, weights: dict[int, float], *keep: str) -> DataFrame:
    """The columns `keep` and a column `score` for every row."""
    schema = docs.select(*keep).schema.add("score", "double")
    bias, learnt = weights.get(-1, 0.0), {f: w for f, w in weights.items() if f >= 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}  # the features of a word that have a weight
        for batch in batches:
            scores = []
            for text in batch.column(batch.num_columns - 1):
                seen: set[int] = set()
                for w in words(text.as_py() or ""):
                    got = known.get(w)
                    if got is None:
                        got = tuple(c for c in codes(w) if c in learnt)
                        if len(known) < 100_000:
                            known[w] = got
                    if got:
                        seen.update(got)
                z = bias + sum(learnt[c] for c in sorted(seen))
                scores.append(sigmoid(z) if weights else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*keep, docs["text"].alias("_text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = score(docs, train(docs, labels), "doc_id")
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not toxic, every column kept."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"), docs["text"])
    return score(rows, train(docs, labels), "_doc").where(F.col("score") < THRESHOLD).select("_doc.*")
