"""Quality classifier: logistic regression over hashed word n-grams with follow-the-regularised-leader updates.

A text is a series of words. Its features are hashed 1- and 2-grams of the words, and hashed 1- and 2-grams of their
shapes (runs of lower-case letters, capitals and digits folded to one sign each, other characters kept), which
generalise over words never seen. A 2-gram of shapes of equal neighbours and a line that occurred before in the text are
marked as such. The value of a feature is its share of all n-grams of its kind, so a score is a sparse dot
product that does not depend on length, plus an intercept.

The model is fitted on at most MAX_TRAIN labelled rows, whose features (MAX_TRAIN_BYTES at most) meet in one task of
its own on an executor; the driver receives 2**BITS weights. Scoring streams over whole texts without a shuffle. doc_id, lang, source and labels
are never inputs of a score.

Nulls: a null text is an empty one and scores the intercept; a null doc_id falls into the fold of the empty
text. Without labels of both kinds every score is 0.5. Repeated rows get equal scores; empty tables give empty
results; extra columns do no harm.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of
from .linear import FTRL, labelled_sample, learn, sigmoid

#: Bounds on the labelled rows that training reads, and on the bytes of their features.
MAX_TRAIN, MAX_TRAIN_BYTES = 8_000, 1 << 28
#: Words that are counted at once; shorter texts are split whole.
BLOCK = 100_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
EPOCHS, BITS = 4, 18
#: Factor that brings shares to the scale of the intercept.
SCALE = 8.0
_RUNS = ((re.compile(r"[^\W\d_]*[^\W\d_A-ZÀ-ÖØ-Þ][^\W\d_A-ZÀ-ÖØ-Þ]*"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"))
_WORD = re.compile(r"\S+")
_MASK = (1 << BITS) - 1


def shape(word: str) -> str:
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word


def code(kind: str, gram: str) -> int:
    return zlib.crc32(f"{kind}{gram}".encode("utf-8", "surrogatepass")) & _MASK


_REPEAT, _LINE, _LINES, _EMPTY = code("=", "repeat"), code("=", "line"), code("=", "lines"), code("=", "empty")


class Extractor:
    """Text -> (features, values), every feature once. Keeps the codes of a bounded number of words of bounded length."""

    def __init__(self, keep: int = 100_000) -> None:
        self.keep = keep
        self.known: dict[str, tuple[int, int]] = {}

    def codes(self, word: str) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            got = (code("w", word.lower()), code("s", shape(word)))
            if len(self.known) < self.keep and len(word) <= 64:
                self.known[word] = got
        return got

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Words are counted some at a time, so beside the text only the counts and the set of its lines grow."""
        n = pairs = 0
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        last: tuple[int, int] | None = None
        for words in word_blocks(text):
            both = np.fromiter((c for w in words for c in self.codes(w)), dtype=np.int64, count=2 * len(words))
            one, form = both[::2], both[1::2]
            before = np.concatenate([[last[0]], one]) if last else one
            shapes = np.concatenate([[last[1]], form]) if last else form
            grams = np.where(before[:-1] == before[1:], _REPEAT, (shapes[:-1] * 40503 + shapes[1:] * 9176 + 77) & _MASK)
            neighbours = (before[:-1] * 69069 + before[1:] * 30011 + 7) & _MASK
            counts += [(np.concatenate([one, form]), np.ones(2 * len(words))), (np.concatenate([grams, neighbours]), np.full(2 * len(grams), -1.0))]
            n, pairs, last = n + len(words), pairs + len(grams), (int(one[-1]), int(form[-1]))
            if len(counts) > 16:
                counts = [_merged(counts, 1.0), _merged(counts, -1.0)]
        if not n:
            return np.array([_EMPTY]), np.array([1.0])
        n_lines, different = line_counts(text)
        again = 1.0 - different / n_lines
        scaled = [(at, np.where(v > 0, v / n, -v / max(1, pairs)) * SCALE) for at, v in counts] + [(np.array([_LINE, _LINES]), np.array([SCALE * again, SCALE * n_lines / n]))]
        at, inverse = np.unique(np.concatenate([a for a, _ in scaled]), return_inverse=True)
        return at, np.bincount(inverse, weights=np.concatenate([v for _, v in scaled]))


def _merged(counts: list[tuple[np.ndarray, np.ndarray]], sign: float) -> tuple[np.ndarray, np.ndarray]:
    """The counts of one sign added up by feature; words count upwards, pairs downwards."""
    at, v = np.concatenate([a for a, _ in counts]), np.concatenate([v for _, v in counts])
    keep = v * sign > 0
    at, inverse = np.unique(at[keep], return_inverse=True)
    return at, np.bincount(inverse, weights=v[keep])


def word_blocks(text: str) -> Iterator[list[str]]:
    """The words of a text, at most BLOCK at a time."""
    if len(text) <= BLOCK:
        if words := text.split():
            yield words
        return
    found = (m[0] for m in _WORD.finditer(text))
    while words := list(islice(found, BLOCK)):
        yield words


def line_counts(text: str) -> tuple[int, int]:
    """(lines with a word, different ones among them); of long lines a digest is remembered."""
    n, seen, at = 0, set(), 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if line := text[at:end].strip():
            n += 1
            seen.add(line if len(line) < 64 else hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        at = end + 1
    return n, len(seen)


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> np.ndarray | None:
    """Weights by feature, the intercept last; None unless both labels occur."""
    extract = Extractor()
    return fit_features([(*extract(text), int(y)) for text, y in rows], epochs)


def fit_features(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray | None:
    """The same from (features, values, label)."""
    if not {0, 1} <= {y for *_, y in examples}:
        return None
    model = FTRL((1 << BITS) + 1, alpha=0.3, beta=1.0, l1=0.2, l2=0.5)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, value, y = examples[i]
            at, value = np.append(at, 1 << BITS), np.append(value, 1.0)
            w = model.weights(at)
            model.update(at, (sigmoid(float(w @ value)) - y) * value, w)
    return model.weights(slice(None))


def apply(text: str, weights: np.ndarray | None, extract: Extractor) -> float:
    if weights is None:
        return 0.5
    at, value = extract(text)
    return sigmoid(float(weights[at] @ value) + float(weights[-1]))


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    def features():
        extract = Extractor()

        def of(text: str) -> tuple[np.ndarray, np.ndarray]:
            at, value = extract(text)
            return at.astype("<i4"), value.astype("<f8")

        return of

    def fitted(rows: list[tuple[bytes, bytes | None, int]]) -> pa.RecordBatch | None:
        learnt = fit_features([(np.frombuffer(x, "<i4"), np.frombuffer(v, "<f8"), y) for x, v, y in rows])
        return None if learnt is None else pa.RecordBatch.from_arrays([pa.array([learnt.astype("<f8").tobytes()], pa.binary())], names=["weights"])

    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, MAX_TRAIN)
    got = learn(sample, features, fitted, "weights binary", MAX_TRAIN_BYTES).collect()
    return np.frombuffer(bytes(got[0].weights), dtype="<f8") if got else None


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    weights = train(docs, labels)
    schema = docs.select("doc_id").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor()
        for batch in batches:
            scores = [apply(text.as_py() or "", weights, extract) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=schema.names)

    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
