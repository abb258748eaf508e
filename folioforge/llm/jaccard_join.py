"""Near-duplicate join on the Jaccard similarity of word shingles, by chosen paths.

A text is the set of its shingles of SHINGLE words, as 64-bit hashes; a text of fewer words has one shingle,
a text without words has none and is similar to nothing. Texts of one set are copies: one of them stands for
all in what follows.

Chosen paths: the root bucket holds every set. From a bucket each set goes on to the buckets of the tokens it
chooses there, about 1 / SIMILARITY of its tokens in number, by a hash of path and token, so that sets above
the threshold are expected to choose at least one token in common. A bucket of at most SMALL sets is searched
by brute force; a larger one is split again, down to DEPTH tokens. A pair at the threshold shares a final
bucket of a run with a known probability, and the number of runs is the least that brings the recall of such
pairs to RECALL; more similar pairs are found more surely.

Buckets are rows of two numbers until their sizes are known; those of one set vanish. Buckets with one least
member are joined to a star, and the sets of its members are compared there once, by exact intersections of
sets, in blocks of at most BLOCK members: a star of k blocks is k * (k + 1) / 2 tasks. A pair that meets in
several stars counts in the one with the least root, so links are exact counts without a row per pair. Stars
report the component of each member, and components are joined over stars by alternating stars of edges.

Nulls: a null text has no words; a null doc_id is a value, less than any other, that comes back as null.
Repeated rows are copies of one another. Sets have numbers of their own and rows are known by doc_id and a hash of the
text, so different texts under one doc_id, or under none, are compared and classed each for itself. Very long texts are
hashed in blocks. Empty tables give empty results; extra columns do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release
from .components import components

SHINGLE = 5
#: The similarity as a fraction, so that the test on counts is exact.
SIMILARITY = (4, 5)
SMALL, DEPTH, RECALL = 256, 3, 0.995
BLOCK = 4096
#: Rows of a matrix of a block that are worked on at once.
_ROWS = 256
_NULL = -(2**63)
_PIECE = 1 << 20
_U = np.uint64
_M = _U(0x2545F4914F6CDD1D)
_K1, _K2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met in a bucket of this depth with probability `recall`.

    The common paths of such a pair are a branching process with one child on average; with Poisson numbers
    of children the chance q of none at depth d follows q(d) = exp(q(d - 1) - 1).
    """
    q = 0.0
    for _ in range(depth):
        q = math.exp(q - 1.0)
    return math.ceil(math.log(1.0 - recall) / math.log(q))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _K1
    x = (x ^ (x >> _U(27))) * _K2
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, 1 << 16)
        _TABLES[:] = [_powers(int(_M), size), _powers(pow(int(_M), -1, 1 << 64), size)]
    return _TABLES[0], _TABLES[1]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, in order."""
    out = []
    while len(data):
        piece = data[:_PIECE]
        if len(piece) < len(data):
            blanks = np.flatnonzero((piece == 32) | ((piece >= 9) & (piece <= 13)))
            if len(blanks):
                piece = data[: int(blanks[-1]) + 1]
            else:  # one word longer than a piece
                rest = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
                piece = data[: int(rest[0]) + 1] if len(rest) else data
        data = data[len(piece) :]
        word = ~((piece == 32) | ((piece >= 9) & (piece <= 13)))
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(begin):
            continue
        up, down = _tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + _U(1)) * up[: len(piece)], out=total[1:])
        out.append(_mixed((total[end] - total[begin]) * down[begin]))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(data: np.ndarray) -> np.ndarray:
    """The sorted set of shingle hashes of a text in UTF-8."""
    words = word_hashes(data)
    n = len(words)
    k = min(SHINGLE, n)
    if not k:
        return words
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        h = h * _K2 + words[i : n - k + 1 + i]
        h ^= h >> _U(29)
    return np.unique(_mixed(h))


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = np.bitwise_xor.reduce(_mixed(tokens * _K1)) if len(tokens) else _U(0)
    b = np.add.reduce(_mixed(tokens + _K2)) if len(tokens) else _U(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def chosen_paths(tokens: np.ndarray, runs: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, parent, path) of every bucket the set goes to; parents of level 1 are 0."""
    n = len(tokens)
    none = np.zeros(0, dtype=np.uint64)
    levels, parents, found = [none.astype(np.int32)], [none], [none]
    paths = _mixed(np.arange(1, runs + 1, dtype=np.uint64) * _M) if n else none
    num, den = SIMILARITY
    limit = _U(min(2**64 - 1, 2**64 * den // (num * max(n, 1))))
    for level in range(1, depth + 1):
        which, after = [none.astype(np.int64)], [none]
        for at in range(0, n if len(paths) else 0, 1 << 16):  # in pieces, so that memory does not grow with the text
            got = _mixed(tokens[None, at : at + (1 << 16)] ^ paths[:, None])
            path, token = np.nonzero(got <= limit)
            which.append(path)
            after.append(_mixed(got[path, token] + _K1))
        here = np.concatenate(which)
        parents.append(paths[here] if level > 1 else np.zeros(len(here), dtype=np.uint64))
        paths = np.concatenate(after)
        levels.append(np.full(len(paths), level, dtype=np.int32))
        found.append(paths)
    return np.concatenate(levels), np.concatenate(parents).view(np.int64), np.concatenate(found).view(np.int64)


def _data(text) -> np.ndarray:
    raw = text.as_buffer() if text.is_valid else None
    return np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)


def _ids(docs: DataFrame, *more: Column) -> DataFrame:
    """id (a null doc_id as the least long), h (a hash of the text), and what else is asked for."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), *more)


def _texts(docs: DataFrame) -> DataFrame:
    return _ids(docs, F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def sketches(docs: DataFrame, runs: int) -> DataFrame:
    """(id, h, a, b, n, nodes): the key and size of each set and its buckets as (level, parent, path)."""

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, n, offsets, nodes = [], [], [], [0], []
        for text in batch.column(2):
            tokens = shingles(_data(text))
            x, y = set_key(tokens)
            a.append(x)
            b.append(y)
            n.append(len(tokens))
            nodes.append(chosen_paths(tokens, runs))
            offsets.append(offsets[-1] + len(nodes[-1][0]))
        columns = [pa.array(np.concatenate([x[k] for x in nodes])) for k in range(3)]
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names=["level", "parent", "path"]))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), listed], names=["id", "h", "a", "b", "n", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield part(batch.slice(at, 1000))

    return _texts(docs).mapInArrow(run, "id long, h long, a long, b long, n long, nodes array<struct<level int, parent long, path long>>")


def _final_buckets(heads: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, list[DataFrame]]:
    """(root, head): the members of the buckets of two sets or more that are not split again, by the least member of each; and what it reads."""
    nodes = heads.select("head", F.explode("nodes").alias("node")).select("head", "node.*")
    found, parents, written = None, None, []
    for level in range(1, depth + 1):
        own = nodes.where(F.col("level") == level)
        if parents is not None:
            own = own.join(parents, "parent", "left_semi")
            own = materialise(own.select("path", "head"), f"split-{level}")
            written.append(own)
        else:
            own = own.select("path", "head")
        sizes = materialise(own.groupBy("path").agg(F.count(F.lit(1)).alias("c"), F.min("head").alias("root")).where("c > 1"), f"buckets-{level}")
        written.append(sizes)
        ready = sizes if level == depth else sizes.where(F.col("c") <= SMALL)
        part = own.join(ready.select("path", "root"), "path").select("root", "head")
        found = part if found is None else found.unionByName(part)
        parents = sizes.where(F.col("c") > SMALL).select(F.col("path").alias("parent"))
    return found.distinct(), written


def _members(docs: DataFrame, stars: DataFrame, heads: DataFrame) -> DataFrame:
    """(root, i, j, block, id, copies, roots, tokens): the members of each star with their sets; id is the number of the set."""
    sizes = stars.groupBy("root").agg(F.count(F.lit(1)).alias("members")).select("root", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    placed = stars.join(sizes, "root")
    per = placed.groupBy("head").agg(F.collect_set(F.struct("root", "blocks")).alias("stars"))  # buckets of one set: bounded by its runs
    wanted = per.join(heads.select("head", "copies", "a", "b", F.col("id").alias("own_id"), F.col("h").alias("own_h")), "head")
    joined = _texts(docs).join(wanted, (F.col("id") == F.col("own_id")) & (F.col("h") == F.col("own_h")))
    schema = "root long, i int, j int, block int, id long, copies long, roots array<long>, tokens binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # a repeated row is fetched again
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for head, text, stars_, copies, a, b in zip(*batch.columns, strict=True):
                head = head.as_py()
                if head in done:
                    continue
                tokens = shingles(_data(text))
                if set_key(tokens) != (a.as_py(), b.as_py()):  # another text of the same hash
                    continue
                done.add(head)
                raw = tokens.tobytes()
                own = [(s["root"], s["blocks"]) for s in stars_.as_py()]
                roots = sorted(r for r, _ in own)
                for root, blocks in own:
                    block = int(_mixed(np.array([head % 2**64], dtype=np.uint64))[0] % _U(blocks))
                    for t in range(blocks):
                        for column, value in zip(out, (root, min(block, t), max(block, t), block, head, copies.as_py(), roots, raw), strict=True):
                            column.append(value)
                if len(out[0]) >= 2000:
                    yield _batch(out)
                    out = [[] for _ in range(8)]
            yield _batch(out)

    def _batch(out: list[list]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["root", "i", "j", "block", "id", "copies", "roots", "tokens"]
        )

    return joined.select("head", "text", "stars", "copies", "a", "b").mapInArrow(run, schema)


def intersections(sets: list[np.ndarray], columns: int = 1024) -> np.ndarray:
    """Matrix of the sizes of all intersections, by products of 0/1 blocks; tokens of a single set are left out.

    Beside the matrix only some columns of the sets and some rows of a product are held at once.
    """
    n = len(sets)
    member = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[token] > 1
    member, token = member[keep], token[keep]
    renumbered = np.cumsum(count > 1) - 1
    token = renumbered[token]
    order = np.argsort(token, kind="stable")
    member, token = member[order], token[order]
    out = np.zeros((n, n), dtype=np.float32)
    width = int(token[-1]) + 1 if len(token) else 0
    for at in range(0, width, columns):
        lo, hi = np.searchsorted(token, [at, at + columns])
        here, local = np.unique(member[lo:hi], return_inverse=True)
        block = np.zeros((len(here), min(columns, width - at)), dtype=np.float32)
        block[local, token[lo:hi] - at] = 1.0
        for a in range(0, len(here), _ROWS):
            out[np.ix_(here[a : a + _ROWS], here)] += block[a : a + _ROWS] @ block.T
    return out


def links_of(ids: np.ndarray, blocks: np.ndarray, copies: np.ndarray, roots: list[list[int]], sets: list[np.ndarray], root: int) -> tuple[np.ndarray, np.ndarray]:
    """(links that count here, least id of the component) of each member of one star or pair of its blocks."""
    num, den = SIMILARITY
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    same = intersections(sets)
    linked = np.empty(same.shape, dtype=bool)
    parts = [slice(a, a + _ROWS) for a in range(0, len(ids), _ROWS)]  # some rows at a time: a matrix of longs would be the largest thing here
    for part in parts:
        linked[part] = same[part].astype(np.int64) * (num + den) >= num * (sizes[part, None] + sizes[None, :])
    del same
    np.fill_diagonal(linked, False)
    if blocks.min() != blocks.max():
        linked &= blocks[:, None] != blocks[None, :]
    # A pair counts in the star with the least root that both have.
    mine = linked.copy()
    less = sorted({r for own in roots for r in own if r < root})
    if less:
        number = {r: k for k, r in enumerate(less)}
        has = np.zeros((len(ids), len(less)), dtype=np.float32)
        for k, own in enumerate(roots):
            for r in own:
                if r < root:
                    has[k, number[r]] = 1.0
        for part in parts:
            mine[part] &= (has[part] @ has.T) == 0
    label = ids.copy()
    while True:
        near = np.concatenate([np.where(linked[part], label[None, :], np.iinfo(np.int64).max).min(axis=1) for part in parts])
        after = np.minimum(label, near)
        if (after == label).all():
            return mine @ copies, label
        label = after


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by root, i, j, id -> (id, links, low)."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        unique = {r[4]: r for r in rows}  # a repeated row of documents is fetched twice
        rows = list(unique.values())
        i, j = rows[0][1], rows[0][2]
        blocks = np.array([r[3] for r in rows])
        if len(rows) < 2 or (i != j and blocks.min() == blocks.max()):
            ids, links, low = [], [], []
        else:
            ids = np.array([r[4] for r in rows], dtype=np.int64)
            links, low = links_of(ids, blocks, np.array([r[5] for r in rows]), [r[6] for r in rows], [np.frombuffer(r[7], dtype=np.uint64) for r in rows], rows[0][0])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(low, pa.int64())], names=["id", "links", "low"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[0][:3] != row[:3]:
                yield work(held)
                held = []
            held.append(row)
    if held:
        yield work(held)


def _classes(docs: DataFrame, recall: float) -> tuple[DataFrame, DataFrame]:
    """(id, h, a, b, n) of every row, and (a, b, least, n_links) of every set: the least (id, h) of its class and its links."""
    made = materialise(sketches(docs, runs_needed(recall)), "sketches")
    firsts = made.where("n > 0").groupBy("a", "b").agg(F.min(F.struct("id", "h")).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("nodes").alias("nodes"))
    heads = materialise(firsts.select("a", "b", "least.*", "copies", "nodes", F.monotonically_increasing_id().alias("head")), "heads")
    buckets, written = _final_buckets(heads)
    stars = materialise(buckets, "stars")
    release(*written)
    dealt = _members(docs, stars, heads).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "id")
    found = materialise(dealt.mapInArrow(_compare, "id long, links long, low long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("u"), F.col("low").alias("v")))
    sets = heads.select("a", "b", "head", "id", "h", "copies").join(links.withColumnRenamed("id", "head"), "head", "left")
    sets = sets.join(roots.withColumnRenamed("node", "head"), "head", "left")
    sets = materialise(sets.select("a", "b", F.coalesce("root", "head").alias("root"), "id", "h", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "sets")
    least = sets.groupBy("root").agg(F.min(F.struct("id", "h")).alias("least"))
    reps = materialise(sets.join(least, "root").select("a", "b", "least", "n_links"), "classes")
    release(heads, stars, found, sets)
    return made.drop("nodes"), reps


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, class_id (least doc_id of its component of links), n_links.

    n_links counts the other rows whose similarity to this one is at least SIMILARITY, copies included.
    """
    made, reps = _classes(docs, recall)
    full = made.where("n > 0").join(reps, ["a", "b"]).select("id", F.col("least.id").alias("class"), "n_links")
    every = full.unionByName(made.where("n = 0").select("id", F.col("id").alias("class"), F.lit(0).cast("long").alias("n_links")))
    return every.select(F.nullif("id", F.lit(_NULL)).alias("doc_id"), F.nullif("class", F.lit(_NULL)).alias("class_id"), "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each class, every column kept: the one with the least doc_id (of several texts of that id, the least hash)."""
    made, reps = _classes(docs, RECALL)
    rows = made.where("n > 0").join(reps, ["a", "b"]).groupBy("id", "h").agg(F.first("least").alias("least"), F.count(F.lit(1)).alias("rows"))
    stays = (F.col("id") == F.col("least.id")) & (F.col("h") == F.col("least.h"))
    gone = materialise(rows.where(~stays).select("id", "h"), "near-copies")
    again = materialise(rows.where(stays & (F.col("rows") > 1)).select("id", "h"), "repeated-rows")
    release(reps)
    docs = _ids(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc")).join(gone, ["id", "h"], "left_anti")
    if again.isEmpty():
        return docs.select("_doc.*")
    single = docs.join(again, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.first("_doc").alias("_doc"))
    return docs.join(again, ["id", "h"], "left_anti").select("_doc.*").unionByName(single.select("_doc.*"))
