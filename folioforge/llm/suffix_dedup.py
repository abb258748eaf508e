"""Removal of repeated substrings by deep-shallow suffix sorting.

A byte goes when a string of LENGTH bytes that covers it also starts earlier: in a document of smaller id, or
earlier in the same one. Matches never cross documents.

1. Every LENGTH-byte string (window) names its anchor: the place of the least hash among its GRAM-byte grams,
   the leftmost of equals. Equal windows have their anchors at the same distance, so a window can only equal
   windows whose anchor holds the same gram. One row per anchor (about one in 43 bytes) is shuffled, and only
   anchors whose gram occurs twice go on.
2. An anchor stands for a run of neighbouring windows; anchors with the same run of bytes (96 bits of its BLAKE2b
   beside the gram) are copies as a whole: all but the first are marked, whatever their number, by an aggregate
   that combines before the shuffle and a join that can split a hot key. So copies are settled before the sort.
3. What is left are first runs that share a gram with a different first run. Their bytes are fetched, dealt out
   by gram and put in suffix order window by window: multikey quicksort, eight bytes a step, to depth SHALLOW;
   groups that are still equal there are ordered by blind tries, which skip the bytes that a whole group
   shares, branch on the first word that differs and check every suffix against its leaf. Windows that end in
   one leaf are equal, and all but the first are marked. A gram with more than HOT different runs is too much
   for one task: its windows are brought together by their bytes, in an aggregate that combines before the shuffle.
4. The marks of a document are joined to it and its bytes removed.

Nothing is collected on the driver. Texts are searched in blocks of BLOCK bytes; only the removal itself holds a
whole text and what is kept of it. A row is known by its doc_id and, where several texts share a doc_id, the hash
of its text, by which such texts are ordered among themselves. Nulls: a null text has no bytes; a null doc_id is
the smallest id. Rows that repeat a doc_id and its text count as one document and get equal results. Texts
shorter than LENGTH bytes lose nothing. Empty tables give empty results; extra columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

LENGTH, GRAM = 100, 16
BLOCK = 1 << 20
SHALLOW = 32
#: Different runs with one gram that are sorted in one place; each has fewer than 200 bytes.
HOT = 20_000
#: Windows that a task puts in order at once.
AT_ONCE = 200_000
_GRAMS = LENGTH - GRAM + 1  # grams of a window
_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_ID = "doc_id long, ver long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _K2
    x ^= x >> _U(29)
    x *= _K3
    x ^= x >> _U(32)
    return x


def _words(data: np.ndarray) -> np.ndarray:
    """The 64-bit little-endian word that starts at each byte."""
    return np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    w = _words(data)
    x = w[: len(w) - 8] * _K1
    y = w[8:] * _K2
    return _mixed(x ^ (y >> _U(23)) ^ (y << _U(17)))


def anchors(data: np.ndarray, starts: int) -> tuple[np.ndarray, ...]:
    """(gram hash, anchor, first window, last window) of the windows that start in [0, starts)."""
    g = gram_hashes(data)
    n = starts + _GRAMS - 1  # grams that some window has
    # The place in the low bits makes the least key name it, the leftmost of equals.
    key = (g[:n] & ~_U(0x1FFFFF)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // _GRAMS)
    padded = np.full(rows * _GRAMS, ~_U(0), dtype=np.uint64)
    padded[:n] = key
    tiles = padded.reshape(rows, _GRAMS)
    upto = np.minimum.accumulate(tiles, axis=1).ravel()
    onward = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(onward[:starts], upto[_GRAMS - 1 : _GRAMS - 1 + starts])
    at = (least & _U(0x1FFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [starts]]) - 1
    anchor = at[first]
    return g[anchor], anchor, first, last


def run_digests(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(long, int) of the bytes of each run."""
    raw = memoryview(data)
    sums = [hashlib.blake2b(raw[a:b], digest_size=12).digest() for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]
    return np.frombuffer(b"".join(sums), dtype=[("a", "<i8"), ("b", "<i4")])


def blocks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """(offset, bytes, number of windows that start there) for the blocks of one text."""
    windows = len(data) - LENGTH + 1
    for at in range(0, max(windows, 0), BLOCK):
        n = min(BLOCK, windows - at)
        yield at, data[at : at + n + LENGTH - 1], n


def _bytes_of(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        raw = x.as_buffer() if x.is_valid else None
        yield np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)


def _pack(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of the anchor, distance to the first and to the last window start, in one long that sorts by place."""
    return (anchor << 16) | ((anchor - first) << 8) | (anchor - last)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gram of every anchor."""
    for batch in batches:
        held, size = [], 0
        for data in _bytes_of(batch.column(2)):
            for _, block, n in blocks(data):
                held.append(anchors(block, n)[0])
                size += len(held[-1])
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["gram"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["gram"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["gram", "run", "more", "place", "doc_id", "ver"]
    for batch in batches:
        parts: list[list] = [[] for _ in names]
        held = 0

        def flush(parts=parts):
            cols = [pa.array(np.concatenate(p)) for p in parts[:4]] + [pa.concat_arrays(p) for p in parts[4:]]
            for p in parts:
                p.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for doc_id, ver, data in zip(batch.column(0), batch.column(1), _bytes_of(batch.column(2)), strict=True):
            for offset, block, n in blocks(data):
                gram, anchor, first, last = anchors(block, n)
                run = run_digests(block, first, last)
                row = gram.view(np.int64), run["a"], run["b"], _pack(anchor + offset, first + offset, last + offset), pa.repeat(doc_id, len(gram)), pa.repeat(ver, len(gram))
                for part, column in zip(parts, row, strict=True):
                    part.append(column)
                held += len(gram)
                if held > 100_000:
                    yield flush()
                    held = 0
        if held:
            yield flush()


def _text_bytes():
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


# --- the suffix order of one group of windows -------------------------------------------------------------


def _be(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as numbers that compare as bytes do."""
    return _words(data)[at].byteswap()


def _split(group: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, word) and number the new groups from 0."""
    order = np.lexsort((word, group))
    g, w = group[order], word[order]
    new = np.concatenate([[False], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
    return order, np.cumsum(new)


def _several(group: np.ndarray) -> np.ndarray:
    return np.bincount(group)[group] > 1


def equal_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which LENGTH-byte strings of a group are equal: (index, class) of those that are not alone.

    `data` ends with seven spare bytes. Shallow part: multikey quicksort by words; deep part: blind tries.
    """
    index = np.arange(len(at))
    group = np.unique(group, return_inverse=True)[1]
    keep = _several(group)
    index, group = index[keep], group[keep]
    for depth in range(0, SHALLOW, 8):
        if not len(index):
            return index, group
        order, group = _split(np.unique(group, return_inverse=True)[1], _be(data, at[index] + depth))
        index = index[order]
        keep = _several(group)
        index, group = index[keep], group[keep]
    return _blind_tries(data, at, index, np.unique(group, return_inverse=True)[1] if len(group) else group)


def _blind_tries(data: np.ndarray, at: np.ndarray, index: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One compacted trie a group, all grown level by level; members stand in order and groups are contiguous."""
    depths = [*range(SHALLOW, LENGTH - 7, 8), LENGTH - 8]
    done_index, done_class, classes = [], [], 0
    while len(index):
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        head = index[heads][group]
        branch = np.full(len(index), len(depths))
        for k in range(len(depths) - 1, -1, -1):
            differs = _words(data)[at[index] + depths[k]] != _words(data)[at[head] + depths[k]]
            branch[differs] = k
        # The depth at which the trie of the group branches; the bytes before it are skipped.
        skip = np.minimum.reduceat(branch, heads)[group]
        leaf = skip == len(depths)
        done_index.append(index[leaf])
        kinds = np.unique(group[leaf], return_inverse=True)[1]
        done_class.append(kinds + classes)
        classes += int(kinds.max()) + 1 if len(kinds) else 0
        index, group, skip = index[~leaf], group[~leaf], skip[~leaf]
        if not len(index):
            break
        order, group = _split(group, _be(data, at[index] + np.array(depths)[skip]))
        index = index[order]
        keep = _several(group)
        index, group = index[keep], group[keep]
        group = np.unique(group, return_inverse=True)[1] if len(group) else group
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *done_index]), np.concatenate([none, *done_class])


def _duplicate_windows(grams: np.ndarray, places: np.ndarray, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, window start) of the windows that an earlier row of the same gram has. Rows stand in (gram, doc_id, place) order."""
    lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
    data = np.frombuffer(b"".join(chunks) + bytes(8), dtype=np.uint8)
    begin = np.cumsum(lengths) - lengths
    anchor, first, last = places >> 16, (places >> 8) & 255, places & 255
    number = np.unique(grams, return_inverse=True)[1] * 256
    rows, starts = [], []

    def sort(waiting: list[tuple[np.ndarray, int]]) -> None:
        row = np.concatenate([r for r, _ in waiting])
        before = np.concatenate([np.full(len(r), d) for r, d in waiting])
        index, kind = equal_windows(data, begin[row] + first[row] - before, number[row] + before)
        order = np.lexsort((index, kind))
        index, kind = index[order], kind[order]
        hit = index[1:][kind[1:] == kind[:-1]]
        rows.append(row[hit])
        starts.append(anchor[row[hit]] - before[hit])

    # Equal windows lie equally far before their anchors, so these distances can be sorted a few at a time.
    waiting, size = [], 0
    for d in range(int(last.min()), int(first.max()) + 1):
        row = np.flatnonzero((last <= d) & (d <= first))
        waiting.append((row, d))
        size += len(row)
        if size >= AT_ONCE:
            sort(waiting)
            waiting, size = [], 0
    if size:
        sort(waiting)
    row, start = np.concatenate(rows), np.concatenate(starts)
    order = np.lexsort((start, row))
    return row[order], start[order]


def _spans(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring window starts of a row as (row, begin, end) of the bytes they cover."""
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.concatenate([cut[1:], [len(row)]]) - 1
    return row[cut], start[cut], start[last] + LENGTH


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, doc_id, ver, place, bytes) sorted by all but the last -> (doc_id, ver, begin, end)."""
    held: list[pa.Table] = []
    names = ["doc_id", "ver", "begin", "end"]

    def work(table: pa.Table) -> pa.RecordBatch:
        # A row that is repeated in the table of documents has been fetched as often.
        ids = [table[c].combine_chunks() for c in ("gram", "doc_id", "ver", "place")]
        keys = [np.stack([c.is_null().to_numpy(zero_copy_only=False).astype(np.int64), c.fill_null(0).to_numpy()]) for c in ids]
        new = np.concatenate([[True], np.logical_or.reduce([(k[:, 1:] != k[:, :-1]).any(axis=0) for k in keys])])
        table = table if new.all() else table.filter(pa.array(new))
        row, start = _duplicate_windows(table["gram"].to_numpy(), table["place"].to_numpy(), table["bytes"].to_pylist())
        if not len(row):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=names)
        r, begin, end = _spans(row, start)
        return pa.RecordBatch.from_arrays([*[table[c].combine_chunks().take(pa.array(r)) for c in ("doc_id", "ver")], pa.array(begin), pa.array(end)], names=names)

    size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < 8_000:
            continue
        table = pa.concat_tables(held)
        grams = table["gram"].to_numpy()
        whole = int(np.searchsorted(grams, grams[-1]))  # the last gram may go on in the next batch
        if whole:
            yield work(table.slice(0, whole))
        held, size = [table.slice(whole)], len(table) - whole
    if size:
        yield work(pa.concat_tables(held))


# --- the plan ------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, ver, text): ver is the hash of the text where a doc_id has several texts, else 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_bytes().alias("text"))
    texts = rows.select("doc_id", F.xxhash64("text").alias("h")).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    several = materialise(texts.where("n > 1").select(F.col("doc_id").alias("s_id"), F.lit(True).alias("several")), "shared-ids")
    ver = F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return rows.join(several, F.col("doc_id").eqNullSafe(F.col("s_id")), "left").select("doc_id", ver.alias("ver"), "text")


def _of_row(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """(doc_id, ver, text, ...) joined with marks(m_id, m_ver, ...)."""
    return docs.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("ver") == F.col("m_ver")), how).drop("m_id", "m_ver")


def _fetch(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The bytes of each run (gram, doc_id, ver, place): one row per run."""
    wanted = runs.groupBy(F.col("doc_id").alias("m_id"), F.col("ver").alias("m_ver")).agg(F.collect_list(F.struct("gram", "place", "hot")).alias("runs"))  # bounded by the document
    joined = _of_row(docs, wanted, "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "doc_id", "ver", "place", "hot", "bytes"]
        for batch in batches:
            for k, text in enumerate(batch.column(2)):
                data = text.as_buffer()
                got = batch.column(3)[k].values
                place = got.field("place").to_numpy()
                anchor, first, last = place >> 16, (place >> 8) & 255, place & 255
                chunks = [data[a:b].to_pybytes() for a, b in zip((anchor - first).tolist(), (anchor - last + LENGTH).tolist(), strict=True)]
                ids = [pa.repeat(batch.column(c)[k], len(place)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([got.field("gram"), *ids, got.field("place"), got.field("hot"), pa.array(chunks, pa.binary())], names=names)

    return joined.select("doc_id", "ver", "text", "runs").mapInArrow(run, f"gram long, {_ID}, place long, hot boolean, bytes binary")


def _hot_spans(rows: DataFrame) -> DataFrame:
    """The duplicate windows of hot grams: one aggregate by the bytes of windows, one join back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (place, raw) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                data = raw.as_py()
                first = (place >> 16) - ((place >> 8) & 255)
                n = len(data) - LENGTH + 1
                ids = [pa.repeat(batch.column(c)[k], n) for c in (0, 1)]
                windows = pa.array([data[i : i + LENGTH] for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*ids, pa.array(range(first, first + n), pa.int64()), windows], names=["doc_id", "ver", "begin", "bytes"])

    windows = rows.select("doc_id", "ver", "place", "bytes").mapInArrow(run, f"{_ID}, begin long, bytes binary")
    here = F.struct("doc_id", "ver", "begin")
    first = windows.groupBy("bytes").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = windows.join(first, "bytes").where(~(here == F.col("first")))
    return again.select("doc_id", "ver", "begin", (F.col("begin") + LENGTH).alias("end"))


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, ver, begin, end) of bytes to remove from rows (doc_id, ver, text); spans may overlap or repeat."""
    # Computed twice rather than stored: anchors take as much room as the texts do.
    grams = docs.mapInArrow(_grams, "gram long")
    every = docs.mapInArrow(_anchor_rows, f"gram long, run long, more int, place long, {_ID}")
    # Written first, so that the join below stands right on its exchanges and Spark can split a hot gram.
    twice = materialise(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "shared-grams")
    shared = materialise(every.join(twice, "gram", "left_semi"), "shared-anchors")
    release(twice)
    here = F.struct("doc_id", "ver", "place")
    first = materialise(shared.groupBy("gram", "run", "more").agg(F.min(here).alias("first")), "first-runs")
    whole = shared.join(first, ["gram", "run", "more"]).where(~(here == F.col("first"))).select("doc_id", "ver", "place")
    anchor = F.shiftright("place", 16)
    begin = (anchor - F.shiftright("place", 8).bitwiseAND(255)).alias("begin")
    copied = materialise(whole.select("doc_id", "ver", begin, (anchor - F.col("place").bitwiseAND(255) + LENGTH).alias("end")), "copied-spans")
    release(shared)
    several = first.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", (F.col("n") > HOT).alias("hot"))
    runs = first.join(several, "gram").select("gram", "first.doc_id", "first.ver", "first.place", "hot")
    fetched = materialise(_fetch(docs, runs), "run-bytes")
    release(first)
    dealt = fetched.where("not hot").select("gram", "doc_id", "ver", "place", "bytes").repartition("gram").sortWithinPartitions("gram", F.col("doc_id").asc_nulls_first(), "ver", "place")
    partly = dealt.mapInArrow(_sorted_groups, f"{_ID}, begin long, end long")
    found = materialise(partly.unionByName(_hot_spans(fetched.where("hot"))), "sorted-spans")
    release(fetched)
    return copied.unionByName(found)


def strip(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with `texts` also the bytes that are kept."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    rows = _keyed(docs)
    spans = duplicate_spans(rows).groupBy(F.col("doc_id").alias("m_id"), F.col("ver").alias("m_ver")).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # bounded by the document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6 if texts else 5)]
            for doc_id, text, got in zip(*batch.columns, strict=True):
                raw = text.as_py()
                n, kept, runs = len(raw), raw, 0
                if got.is_valid and len(got.values):
                    begin, end = got.values.field("begin").to_numpy(), np.minimum(got.values.field("end").to_numpy(), n)
                    order = np.argsort(begin, kind="stable")
                    begin, end = begin[order], np.maximum.accumulate(end[order])
                    cut = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                    begin, end = begin[cut].tolist(), end[np.concatenate([cut[1:], [len(end)]]) - 1].tolist()
                    runs = len(begin)
                    kept = b"".join(raw[a:b] for a, b in zip([0, *end], [*begin, n], strict=True))
                row = [doc_id.as_py(), n, n - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept]
                for column, value in zip(out, row, strict=False):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names[: len(out)])

    return _of_row(rows, spans, "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
