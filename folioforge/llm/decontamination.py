"""Benchmark decontamination by Wu-Manber search for windows of benchmark words.

A-Z are lower-cased; words are runs of digits, letters a-z and bytes beyond ASCII. A window is WINDOW consecutive words
of one item, an item of fewer words (but not none) is one window. A text in normal form is its words between single
blanks, with a blank before the first and behind the last; a window occurs in a document where its normal form does.

The search: windows of one number of words and of similar length form a class, of which the first m bytes count, m being
its least length. A table says for every block of BLOCK bytes how far the next place where a window could end its
first m bytes must be away, so most places of a text are never looked at. Texts are searched in lanes side by side, each
of which moves on by its own shift. Where the shift is 0, the hash of that block (the suffix of the m bytes), of the window's
first and last bytes and of its length selects the bucket of windows that may stand there, and all bytes are compared.

Only the benchmark is sent to the tasks, at most SHARD bytes of it at once: a larger one is dealt to as many shards
as it needs, each of which has a pass over the documents, and the passes meet by row. Documents are never shuffled
while one shard is enough.

Nulls: a null text has no words, a null item_id is the empty string, a null doc_id comes back as null. Rows that repeat
an item_id are one item with the windows of all its texts. Long items are cut into overlapping pieces, long texts are
searched whole. Documents or benchmarks without rows give no rows, or rows without hits. Extra columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

WINDOW = 10
BLOCK = 8
#: Bytes of benchmark text that are searched for in one pass; words of a piece of a long item.
SHARD, PIECE = 16 << 20, 100_000
#: Bytes of text that are searched at once; places of one lane.
BUFFER, LANE = 4 << 20, 2048
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)


def normal_form(data: bytes) -> bytes:
    words = data.translate(_TABLE).split()
    return b" %b " % b" ".join(words) if words else b""


def _read(data: np.ndarray, at: np.ndarray, n: np.ndarray | int = 8) -> np.ndarray:
    """The `n` bytes (8 at most) from each place on, as numbers; `data` ends in 8 bytes more than are used."""
    view = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    full = view[at]
    return full if isinstance(n, int) and n >= 8 else full & (~_U(0) >> (_U(64) - _U(8) * np.minimum(n, 8).astype(np.uint64)))


def _padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(8), dtype=np.uint8)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), dtype=np.uint64)
    for x in parts:
        h = (h ^ x.astype(np.uint64)) * _K
        h ^= h >> _U(29)
    return h


class Class:
    """The tables of the windows (place and length in `text`) of one number of words and of similar length."""

    def __init__(self, text: np.ndarray, which: np.ndarray, start: np.ndarray, length: np.ndarray, words: int) -> None:
        self.words, self.m = words, int(length.min())
        self.block = min(BLOCK, self.m)
        steps = self.m - self.block + 1
        self.bits = max(10, min(22, int(len(which) * steps * 16).bit_length()))
        self.shift = np.full(1 << self.bits, min(steps, 255), dtype=np.uint8)
        for end in range(max(self.block, self.m - 254), self.m + 1):  # from far to near, so the least shift stays
            self.shift[self.slots(_read(text, start + end - self.block, self.block))] = self.m - end
        keys = self.bucket(text, start, length)
        order = np.argsort(keys, kind="stable")
        self.keys, self.which = keys[order], which[order]

    def slots(self, block: np.ndarray) -> np.ndarray:
        return ((block * _K) >> _U(64 - self.bits)).astype(np.int64)

    def bucket(self, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A hash of the block, the first and last bytes and the length of the windows at these places."""
        ends = [_read(data, at, length), _read(data, at + length - np.minimum(length, 8), length)]
        return _mixed(_read(data, at + self.m - self.block, self.block), *ends, length)

    def candidates(self, data: np.ndarray) -> np.ndarray:
        """Places at which a window may begin, found by shifts."""
        n = len(data) - 8
        at = np.arange(self.m, n + 1, LANE)
        end, found = np.minimum(at + LANE, n + 1), [np.zeros(0, dtype=np.int64)]
        while len(at):
            shift = self.shift[self.slots(_read(data, at - self.block, self.block))]
            found.append(at[shift == 0] - self.m)
            at = at + np.maximum(shift, 1)
            on = at < end
            at, end = at[on], end[on]
        return np.concatenate(found)


class Patterns:
    """What is searched for: (item, normal form) of every piece of an item."""

    def __init__(self, pieces: list[tuple[str, bytes]]) -> None:
        self.items = sorted({item for item, _ in pieces})
        number = {item: k for k, item in enumerate(self.items)}
        self.text = _padded(b"".join(form for _, form in pieces))
        starts, lengths, words, owners, at = [], [], [], [], 0
        for item, form in pieces:
            gaps = np.flatnonzero(np.frombuffer(form, dtype=np.uint8) == 32) + at
            k = min(WINDOW, len(gaps) - 1)
            starts.append(gaps[: len(gaps) - k])
            lengths.append(gaps[k:] + 1 - gaps[: len(gaps) - k])
            words.append(np.full(len(gaps) - k, k))
            owners.append(np.full(len(gaps) - k, number[item]))
            at += len(form)
        none = np.zeros(0, dtype=np.int64)
        start, length, word, owner = (np.concatenate([none, *x]) for x in (starts, lengths, words, owners))
        raw = self.text.tobytes()
        digests = b"".join(hashlib.blake2b(raw[s : s + n], digest_size=16).digest() for s, n in zip(start.tolist(), length.tolist(), strict=True))
        _, first, same = np.unique(np.frombuffer(digests, dtype="V16"), return_index=True, return_inverse=True)
        self.start, self.length, word = start[first], length[first], word[first]
        pairs = np.unique(np.stack([same.ravel(), owner], axis=1), axis=0)  # the items of each different window
        self.owners, self.own_from = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.classes = []
        kinds = word * 64 + np.log2(np.maximum(self.length, 1)).astype(np.int64)
        for kind in np.unique(kinds):
            which = np.flatnonzero(kinds == kind)
            self.classes.append(Class(self.text, which, self.start[which], self.length[which], int(kind) // 64))

    def equal(self, data: np.ndarray, at: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Does the window stand at the place, byte by byte?"""
        length, start = self.length[window], self.start[window]
        on = at + length <= len(data) - 8
        for k in range(0, int(length.max(initial=0)), 8):
            left = np.flatnonzero(on & (length > k))
            n = length[left] - k
            on[left] = _read(data, at[left] + k, n) == _read(self.text, start[left] + k, n)
        return on

    def occurrences(self, data: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the first word's blank, number of words, window) of every occurrence in normal forms; `gaps` are their blanks."""
        out = []
        for c in self.classes:
            at = c.candidates(data)
            at = at[data[at] == 32]
            first = np.searchsorted(gaps, at)
            whole = first + c.words < len(gaps)
            at, first = at[whole], first[whole]
            length = gaps[first + c.words] + 1 - at
            fits = length >= c.m
            at, first, length = at[fits], first[fits], length[fits]
            keys = c.bucket(data, at, length)
            low, high = np.searchsorted(c.keys, keys, "left"), np.searchsorted(c.keys, keys, "right")
            n = high - low
            each = np.repeat(np.arange(len(at)), n)
            window = c.which[np.repeat(low, n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
            good = self.equal(data, at[each], window)
            out.append((first[each][good], np.full(int(good.sum()), c.words), window[good]))
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate([none, *(x[k] for x in out)]) for k in range(3))

    def search(self, forms: list[bytes]) -> Iterator[tuple[int, list[int], list[str]]]:
        """(words, first and next word of every run of hit words, items) of each normal form."""
        data = _padded(b"\n".join(forms))
        begin = np.cumsum([0, *(len(f) + 1 for f in forms)])
        gaps = np.flatnonzero(data == 32)
        from_gap = np.searchsorted(gaps, begin)
        n_words = np.maximum(np.diff(from_gap) - 1, 0)
        first, words, window = self.occurrences(data, gaps)
        doc = np.searchsorted(from_gap, first, "right") - 1
        order = np.argsort(doc, kind="stable")
        first, words, window = first[order], words[order], window[order]
        cut = np.searchsorted(doc[order], np.arange(len(forms) + 1))
        for k in range(len(forms)):
            mine = slice(cut[k], cut[k + 1])
            if cut[k] == cut[k + 1]:
                yield int(n_words[k]), [], []
                continue
            step = np.zeros(n_words[k] + 1, dtype=np.int64)
            np.add.at(step, first[mine] - from_gap[k], 1)
            np.add.at(step, first[mine] - from_gap[k] + words[mine], -1)
            edges = np.flatnonzero(np.diff(np.cumsum(step) > 0, prepend=False))
            found = {int(o) for w in np.unique(window[mine]) for o in self.owners[self.own_from[w] : self.own_from[w + 1]]}
            yield int(n_words[k]), edges.tolist(), [self.items[o] for o in sorted(found)]


def item_pieces(benchmark: DataFrame) -> DataFrame:
    """(item, form): the normal form of every item with words; long ones in pieces that share WINDOW - 1 words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, forms = [], []
            for item, text in zip(*batch.columns, strict=True):
                words = text.as_py().translate(_TABLE).split()
                for at in range(0, max(len(words) - WINDOW + 1, min(len(words), 1)), PIECE):
                    items.append(item.as_py())
                    forms.append(b" %b " % b" ".join(words[at : at + PIECE + WINDOW - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(forms, pa.binary())], names=["item", "form"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(cut, "item string, form binary").distinct()


def _buffers(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(keys, normal forms) of some rows at a time, whose last column is the text as bytes."""
    keys, forms, held = [], [], 0
    for batch in batches:
        names = batch.column(0).to_pylist()
        for key, text in zip(names, batch.column(batch.num_columns - 1), strict=True):
            forms.append(normal_form(text.as_buffer().to_pybytes() if text.is_valid else b""))
            keys.append(key)
            held += len(forms[-1]) + 1
            if held >= BUFFER:
                yield keys, forms
                keys, forms, held = [], [], 0
    if keys:
        yield keys, forms


def _judged(n_words: int, edges: list[int], items: list[str]) -> tuple:
    hit = sum(edges[1::2]) - sum(edges[::2])
    return n_words, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>, items array<string>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string())]
_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"]


def _merged(edges: list[int]) -> list[int]:
    """Runs (begin, end, begin, end, ...) in any order and overlapping -> their union in order."""
    out: list[int] = []
    for a, b in sorted(zip(edges[::2], edges[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _pass(docs: DataFrame, key: str, patterns: Patterns) -> DataFrame:
    """key and RESULT of every row, searched for these patterns."""
    kind = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(patterns)
    key_type = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, forms in _buffers(batches):
            rows = [(*_judged(n, e, i), e, i) for n, e, i in held.value.search(forms)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES))], names=[key, *_NAMES])

    return docs.select(key, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{key} {kind}, {RESULT}")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans and items of every document.

    `spans` holds the first and the next word of every run of hit words, in turn; `items` the sorted ids.
    """
    if docs.schema["doc_id"].dataType.simpleString() not in ("string", "bigint", "int"):
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = materialise(item_pieces(benchmark), "benchmark-pieces")
    size = pieces.agg(F.sum(F.octet_length("form")).alias("n")).first().n or 0
    shards = max(1, -(-size // SHARD))
    shard = lambda k: Patterns([(r.item, bytes(r.form)) for r in pieces.where(F.pmod(F.xxhash64("item", "form"), F.lit(shards)) == k).collect()])
    if shards == 1:
        out = _pass(docs, "doc_id", shard(0))
        release(pieces)
        return out
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered-documents")
    found = None
    for k in range(shards):
        part = materialise(_pass(rows, "row", shard(k)).where(F.lit(k == 0) | F.col("contaminated")).select("row", "n_words", "spans", "items"), f"hits-{k}")
        found = part if found is None else found.unionByName(part)
    release(pieces)
    met = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, e, i in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                e = _merged(e)
                rows.append((*_judged(n, e, i), e, i))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES))], names=["row", *_NAMES])

    return rows.select("row", "doc_id").join(met.mapInArrow(join, f"row long, {RESULT}"), "row").drop("row")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return hits(docs, benchmark).drop("spans", "items")
