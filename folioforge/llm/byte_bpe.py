"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte parts. Every adjacent pair whose concatenation has a rank stands in the
bucket of that rank, by the position of its left part. A three-level bitmap over the ranks says which buckets
hold something, so the lowest rank is found by three find-first-set steps, whatever the length of the
pre-token; entries whose pair has changed meanwhile are skipped when they surface. Of equal ranks the leftmost
pair merges first. A pre-token of n bytes costs O(n log n) at worst, so megabytes without a break are no problem.

Encoded pre-tokens are remembered in two tables of bounded size in each Python worker. Texts stream through in
slices; nothing is collected. Nulls: a null text is an empty one, which has no ids. Repeated rows give a result
each; empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Entries of each of a worker's two tables of encoded pre-tokens, and the longest pre-token kept in it.
CACHE, CACHED_LEN = 240_000, 64
#: Characters from which on a text is worked through in parts.
LONG = 1 << 20
VOCABULARY = "byte_bpe_50k.tiktoken"


class RankQueue:
    """The bitmap levels over ranks below 2**18 and the buckets; empty between pre-tokens, so it is made once.

    A bucket is a position, or a heap of positions when pairs of one rank meet.
    """

    def __init__(self) -> None:
        self.leaves = [0] * 4096
        self.middle = [0] * 64
        self.root = 0
        self.buckets: dict[int, int | list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        held = self.buckets.get(rank)
        if held is None:
            self.buckets[rank] = position
            leaf = rank >> 6
            if not self.leaves[leaf]:
                top = rank >> 12
                self.middle[top] |= 1 << (leaf & 63)
                self.root |= 1 << top
            self.leaves[leaf] |= 1 << (rank & 63)
        elif type(held) is int:
            self.buckets[rank] = [held, position] if held < position else [position, held]
        else:
            heappush(held, position)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position; only where `root` is not 0."""
        top = (self.root & -self.root).bit_length() - 1
        word = self.middle[top]
        leaf = top << 6 | (word & -word).bit_length() - 1
        bits = self.leaves[leaf]
        rank = leaf << 6 | (bits & -bits).bit_length() - 1
        held = self.buckets[rank]
        if type(held) is int:
            position = held
        else:
            position = heappop(held)
            if held:
                return rank, position
        del self.buckets[rank]
        self.leaves[leaf] = bits = bits & (bits - 1)
        if not bits:
            self.middle[top] = word = word & (word - 1)
            if not word:
                self.root &= self.root - 1
        return rank, position


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.pieces = {i: b for b, i in ranks.items()}
        self.queue = RankQueue()
        # Two generations of encoded pre-tokens: when the young one is full, it replaces the old one.
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        queue = self.queue
        push, pop = queue.push, queue.pop
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        pair = [-1] * n  # the rank of the pair that starts here; -1: none, or no part starts here
        for i in range(n - 1):
            r = rank_of(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                push(r, i)
        while queue.root:
            rank, i = pop()
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[j]
            pair[j] = -1
            after[i] = k
            before[k] = i
            r = rank_of(piece[i : after[k]]) if k < n else None
            if r is None:
                pair[i] = -1
            else:
                pair[i] = r
                push(r, i)
            h = before[i]
            if h >= 0:
                r = rank_of(piece[h:k])
                if r is None:
                    pair[h] = -1
                elif r != pair[h]:
                    pair[h] = r
                    push(r, h)
        out, i = [], 0
        while i < n:
            k = after[i]
            out.append(rank_of(piece[i:k]))
            i = k
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in part] if len(text) > LONG else self._ids(self.pattern.findall(text))

    def parts(self, text: str) -> Iterator[list[int]]:
        """The ids of a text in parts of bounded size."""
        if len(text) <= LONG:
            yield self._ids(self.pattern.findall(text))
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while pieces := list(islice(found, 100_000)):
            yield self._ids(pieces)

    def _ids(self, pieces: list[str]) -> list[int]:
        young, old, ids = self.young, self.old, []
        for piece in pieces:
            got = young.get(piece)
            if got is None:
                got = old.get(piece)
                if got is None:
                    got = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= CACHED_LEN:
                    if len(young) >= CACHE:
                        self.old, self.young = old, young = young, {}
                    young[piece] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(path), pattern)


def installed(vocabulary: str = VOCABULARY) -> tuple[str, str]:
    """(path, pattern) of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(vocabulary), public_tokenizers.PATTERN


@lru_cache(maxsize=1)
def _digits(path: str, pattern: str) -> list[str]:
    return [str(i) for i in range(max(load(path, pattern).pieces) + 1)]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; with `ids` also the ids themselves.

    The vocabulary is found by name in the installed package of every worker, so no path travels.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = installed(vocabulary)
        bpe, digits = load(*at), _digits(*at)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                n, sums, got = 0, (hashlib.sha256(), hashlib.sha256()), []
                for part in bpe.parts(text.as_py() or ""):
                    said = " ".join(map(digits.__getitem__, part)).encode()
                    sums[0].update(b" " + said if n and part else said)
                    sums[1].update(bpe.decode(part))
                    n += len(part)
                    if ids:
                        got += part
                out[0].append(doc_id.as_py())
                out[1].append(n)
                out[2].append(sums[0].hexdigest())
                out[3].append(sums[1].hexdigest())
                if ids:
                    out[4].append(pa.array(got, pa.int32()))
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                arrays.append(pa.array([x.to_pylist() for x in out[4]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)
