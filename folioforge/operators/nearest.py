"""Nearest vectors with exact scores: all vectors of equal keys and size against all, in tiles; by inverted lists where a caller wants that.

Vectors that are equal form one unit, which knows the ids that can be among its best: at most k a group and 2 k in all. Units of
equal keys and size form a set. A set is searched whole and exactly, however large it is.

A caller that names a size of lists gives up exactness: units are dealt to lists by spherical centroids, fitted to a sample of at most
SAMPLE vectors, and every query goes to the lists whose centroids are nearest. How many these are is measured: of ASKED queries the exact
neighbours are found by a scan, and the least number of probes that meets a share RECALL of them is taken. Vectors without structure
would have to go to more than one list in MOST_PROBED: these sets are searched whole, and so are sets of at most NARROW lists. Every
vector is indexed and scores are always exact.

A search of a set, or of a list, is cut into tiles: its queries into SIDE parts (more only where a part would pass QUERY_BYTES), its units into
STREAMS parts. A task holds one part of the queries with their best so far, and the units pass by in blocks of BLOCK. So a query
is sent STREAMS times and a unit SIDE times, and a query has at most STREAMS times k rows to be ranked, however many units there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import stored

BLOCK = 2048
#: Where the size of lists is given: lists up to which a set is searched whole; the share of its lists, one in so many, from which on it is as well.
NARROW, MOST_PROBED = 16, 4
#: Most lists; most sampled vectors, so many a list.
MOST_LISTS, SAMPLE, PER_LIST = 4096, 65_536, 32
#: Parts of the queries of a list and of its units; fewest queries of a part; most bytes of its vectors in single precision.
SIDE, STREAMS, LEAST_QUERIES, QUERY_BYTES = 16, 2, 512, 16 << 20
#: Share of the exact neighbours that the probes must meet, and the queries on which that is measured.
RECALL, ASKED = 0.95, 256
#: Scores closer than this are ties; what single precision may be wrong by.
_TIE, _SINGLE = 1e-9, 1e-5
_DIM = "_size"


def _units(vectors: DataFrame, keys: list[str], k: int, other_group: bool) -> DataFrame:
    """(keys, unit, vector, items): different vectors with the (id, grp) that may be among the k best of a query, by id."""
    codes = [F.xxhash64("vector").alias("_a"), F.xxhash64(F.lit(7), "vector").alias("_b")]
    same = [*keys, "_a", "_b"]
    rows = vectors.select(*keys, "id", "grp", *codes)
    if other_group:  # of one group k are enough, and of 2 k with at most k a group k are of other groups than any
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*same, "grp").orderBy("id"))).where(F.col("_r") <= k)
    most = 2 * k if other_group else k
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*same).orderBy("id"))).where(F.col("_r") <= most)
    items = rows.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("id", "grp"))).alias("items"))
    firsts = vectors.select(*keys, *codes, "vector").groupBy(*same).agg(F.first("vector").alias("vector"))
    return firsts.join(items, same).select(*keys, F.xxhash64("_a", "_b").alias("unit"), "vector", "items")


def centroids(sample: DataFrame, lists: int, most: int, rounds: int = 8) -> dict[int, np.ndarray]:
    """Of each size of vectors in `sample` (size, vector) the `lists` centroids by spherical k-means, from the first `most` by hash; one task a size."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for size, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = held.setdefault(size, [])
                if len(rows) < most:
                    rows.append(vector.values.to_numpy(zero_copy_only=False).astype(np.float32))
        for size, rows in held.items():
            x = np.stack(rows)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            c = x[:lists].copy()
            for _ in range(rounds):
                own = np.concatenate([np.argmax(x[at : at + 4096] @ c.T, axis=1) for at in range(0, len(x), 4096)])
                sums = np.zeros_like(c)
                np.add.at(sums, own, x)
                length = np.linalg.norm(sums, axis=1, keepdims=True)
                c = np.where(length > 0, sums / np.maximum(length, 1e-30), c).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(c), pa.int32()), pa.array(list(c), pa.list_(pa.float32()))], names=["size", "centroid"])

    found: dict[int, list] = {}
    for row in sample.repartition("size").sortWithinPartitions("size", F.xxhash64("vector")).mapInArrow(fit, "size int, centroid array<float>").collect():  # at most MOST_LISTS a size
        found.setdefault(row.size, []).append(row.centroid)
    return {size: np.array(rows, dtype=np.float32) for size, rows in found.items()}


def _routed(rows: DataFrame, found: dict[int, np.ndarray], probes: int) -> DataFrame:
    """`rows` (wide, vector, ...) with `lists`: the nearest lists, or list 0 where the search is not wide."""
    if not found:
        return rows.withColumn("lists", F.array(F.lit(0)))
    held = rows.sparkSession.sparkContext.broadcast(found)  # at most MOST_LISTS centroids a size
    at, wide = rows.columns.index("vector"), rows.columns.index("wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                lists = [[0]] * batch.num_rows
                sizes = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
                chosen = batch.column(wide).to_numpy(zero_copy_only=False).astype(bool)
                for size in np.unique(sizes[chosen]):
                    mine = np.flatnonzero(chosen & (sizes == size))
                    x = batch.column(at).take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(mine), -1)
                    c = held.value[int(size)]
                    near = x @ c.T
                    n = min(probes, len(c))
                    best = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(mine), 1))
                    for i, b in zip(mine, best, strict=True):
                        lists[i] = b.tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "lists array<int>"])
    return rows.mapInArrow(run, schema)


def probes_needed(asked: DataFrame, held: DataFrame, found: dict[int, np.ndarray], k: int, keys: list[str]) -> int:
    """The least number of probes that meets RECALL of the k nearest units of sampled queries, of the largest set that is not narrow."""
    largest = held.where("wide").groupBy(*keys).count().orderBy(F.desc("count"), *keys).first()
    inside = F.lit(True)
    for c in keys:
        inside = inside & F.col(c).eqNullSafe(F.lit(largest[c]))
    sample = [np.array(r.vector, dtype=np.float32) for r in asked.where(inside).orderBy(F.xxhash64("id", "vector")).select("vector").limit(ASKED).collect()]
    if not sample:
        return 1
    x = np.stack(sample)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sent = held.sparkSession.sparkContext.broadcast(x)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        best, lists = np.full((len(q), k), -2.0, dtype=np.float32), np.full((len(q), k), -1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                y = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(some.num_rows, -1)
                s = np.concatenate([best, q @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T], axis=1)
                of = np.concatenate([lists, np.broadcast_to(some.column(0).to_numpy(), (len(q), some.num_rows))], axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best, lists = np.take_along_axis(s, top, 1), np.take_along_axis(of, top, 1)
        row = np.repeat(np.arange(len(q)), k)
        good = lists.ravel() >= 0
        yield pa.RecordBatch.from_arrays([pa.array(row[good]), pa.array(lists.ravel()[good]), pa.array(best.ravel()[good])], names=["q", "list", "score"])

    near = held.where(inside).select("list", "vector").mapInArrow(scan, "q long, list long, score float")
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list"))).where(F.col("_r") <= k).collect()  # k rows a query
    c = found[x.shape[1]]
    place = np.argsort(np.argsort(-(x @ c.T), axis=1), axis=1)
    places = np.sort([place[r.q, r.list] for r in near])
    return min(len(c), int(places[max(0, int(np.ceil(RECALL * len(places))) - 1)]) + 1)


def _matrix(items: pa.StructScalar) -> np.ndarray:
    vectors = items.field("vector")
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class _Best:
    """The k best items of some queries among the units that have passed by, by exact score and id."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, least: float, other_group: bool):
        self.id, self.grp, self.x = (np.concatenate(part) for part in zip(*blocks, strict=True))
        self.near, self.k, self.least, self.other_group = self.x.astype(np.float32), k, least, other_group
        self.floor = np.full(len(self.x), least, dtype=np.float64)
        self.row, self.score = np.zeros(0, dtype=np.int64), np.zeros(0)
        self.item, self.group = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def pass_by(self, y: np.ndarray, count: np.ndarray, ids: np.ndarray, groups: np.ndarray) -> None:
        """Units `y` with `count` items each, end to end."""
        first = np.cumsum(count) - count
        single = y.astype(np.float32).T
        low, high = np.minimum.reduceat(groups, first), np.maximum.reduceat(groups, first)
        for at in range(0, len(self.x), BLOCK):
            s = self.near[at : at + BLOCK] @ single
            grp, floor = self.grp[at : at + BLOCK], self.floor[at : at + BLOCK]
            open_ = np.flatnonzero(floor <= self.least)
            if len(open_) and self.k < s.shape[1]:  # no k items yet: k different units give a floor
                some = -s[open_]
                if self.other_group:  # not a unit all of whose items are of the query's own group
                    some[(grp[open_, None] == low[None, :]) & (low == high)[None, :]] = 2.0
                some.partition(self.k - 1, axis=1)
                floor[open_] = np.maximum(floor[open_], -some[:, self.k - 1] - _SINGLE)
            row, unit = np.nonzero(s >= (floor - _SINGLE).astype(np.float32)[:, None])
            if not len(row):
                continue
            row = row + at
            score = np.concatenate([np.einsum("ij,ij->i", self.x[row[a : a + 65_536]], y[unit[a : a + 65_536]]) for a in range(0, len(row), 65_536)])
            good = score >= self.least
            row, unit, score = row[good], unit[good], score[good]
            n = count[unit]
            each = np.repeat(np.arange(len(unit)), n)
            item = np.repeat(first[unit], n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            row, score = row[each], score[each]
            if self.other_group:
                good = groups[item] != self.grp[row]
                row, item, score = row[good], item[good], score[good]
            self.fresh.append((row, score, ids[item], groups[item]))
            self.waiting += len(row)
            if self.waiting > max(65_536, self.k * len(self.x)):
                self.settle()

    def settle(self) -> None:
        """Of what came in only the best stay."""
        row, score, item, group = (np.concatenate(part) for part in zip((self.row, self.score, self.item, self.group), *self.fresh, strict=True))
        order = np.lexsort((item, -np.round(score, 9), row))
        row, score, item, group = row[order], score[order], item[order], group[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        stays = place < self.k
        last = place == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last] - 2 * _TIE)
        self.row, self.score, self.item, self.group = row[stays], score[stays], item[stays], group[stays]
        self.fresh, self.waiting = [], 0


def _by_lists(rows: DataFrame, units: DataFrame, asked: DataFrame, keys: list[str], k: int, list_size: int, probes: int | None) -> tuple[DataFrame, DataFrame]:
    """`units` and `asked` with the list where they are searched."""
    sets = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, (F.col("_n") > NARROW * list_size).alias("wide"), "_n")
    most = sets.where("wide").agg(F.max("_n").alias("n")).first().n
    whole = units.withColumn("list", F.lit(0)), asked.withColumn("list", F.lit(0))
    if not most:
        return whole
    units, asked = stored(units.join(sets.drop("_n"), keys), "units"), asked.join(sets.drop("_n"), keys)
    lists = min(MOST_LISTS, -(-most // list_size))
    taken = min(SAMPLE, PER_LIST * lists)
    share = int(min(1.0, 1.5 * taken / most) * 1_000_000)
    sample = units.where(F.col("wide") & (F.pmod(F.xxhash64(F.lit(3), "vector"), F.lit(1_000_000)) < share))
    found = centroids(sample.select(F.col(_DIM).alias("size"), "vector"), lists, taken)
    held = stored(_routed(units, found, 1).withColumn("list", F.col("lists")[0]).drop("lists"), "lists")
    measured = probes or probes_needed(asked, held, found, k, keys)
    if not probes and measured * MOST_PROBED > lists:  # without structure the lists only cost
        return whole
    return held.drop("wide"), _routed(asked, found, measured).withColumn("list", F.explode("lists")).drop("lists", "wide")


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int, least: float = -1.0, keys: list[str] | None = None, other_group: bool = False,
    *, list_size: int | None = None, probes: int | None = None,
) -> DataFrame:
    """(keys, query_id, query_grp, id, grp, score, rank): the k rows of highest cosine for each query, the smaller id first of equals.

    queries and vectors have the columns of `keys`, id (long), grp (long) and vector; only rows of equal keys
    and vectors of one size meet. `other_group` leaves out rows of the query's own group. Vectors without length are near
    to nothing. Scores that differ by less than 1e-9 are ties. The search is exact at any size; with `list_size` it goes by lists of
    about so many vectors, of which `probes` are searched for each query, or as many as meet a share RECALL of the exact result.
    """
    own = keys or []
    keys = [*own, _DIM]
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    pick = lambda rows: rows.select(*own, F.size("vector").alias(_DIM), F.col("id").cast("long").alias("id"), F.col("grp").cast("long").alias("grp"), "vector").where(length > 0)
    rows = pick(vectors)
    held, sent = _units(rows, keys, k, other_group), pick(queries)
    at = [*keys, "list"]
    if list_size:
        held, sent = _by_lists(rows, held, sent, keys, k, list_size, probes)
    else:  # every set is one list
        held, sent = held.withColumn("list", F.lit(0)), sent.withColumn("list", F.lit(0))
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(64 * BLOCK) / F.col(_DIM))))  # rows of a block: wide vectors are fewer
    n, held_by = F.count(F.lit(1)), F.floor(F.lit(QUERY_BYTES) / (4 * F.col(_DIM))) + 1
    sides = F.greatest(F.least(F.lit(SIDE), F.ceil(F.col("_n") / LEAST_QUERIES)), F.ceil(F.col("_n") / held_by)).cast("int")
    blocks = F.ceil(F.col("_n") / room).cast("int")
    queried = sent.groupBy(*at).agg(n.alias("_n")).select(*at, sides.alias("_sides"), F.greatest(sides, blocks).alias("_parts"))
    sizes = held.groupBy(*at).agg(n.alias("_n")).select(*at, blocks.alias("_blocks"), F.least(F.lit(STREAMS), blocks).alias("_streams"))
    sizes = stored(sizes.join(queried, at), "tiles")
    asking = sent.join(sizes, at).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    asking = asking.groupBy(*at, "_b").agg(F.collect_list(F.struct("id", "grp", "vector")).alias("q"), F.first("_sides").alias("_sides"), F.first("_streams").alias("_streams"))
    streams = F.explode(F.sequence(F.lit(0), F.col("_streams") - 1))
    passing = held.join(sizes, at).withColumn("_b", F.pmod("unit", F.col("_blocks")).cast("int"))
    passing = passing.groupBy(*at, "_b").agg(F.collect_list(F.struct("vector", "items")).alias("v"), F.first("_sides").alias("_sides"), F.first("_streams").alias("_streams"))
    part = lambda rows, name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    asking = asking.select(*at, (F.col("_b") % F.col("_sides")).alias("_q"), streams.alias("_v"), F.lit(-1).alias("_turn"), "q", part(passing, "v"))
    passing = passing.select(*at, F.explode(F.sequence(F.lit(0), F.col("_sides") - 1)).alias("_q"), (F.col("_b") % F.col("_streams")).alias("_v"), F.col("_b").alias("_turn"), part(asking, "q"), "v")
    tile = [*at, "_q", "_v"]
    many = max(2 * SIDE * STREAMS, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tiles = asking.unionByName(passing).repartition(many, *tile).sortWithinPartitions(*tile, "_turn")
    fields = [queries.schema[c] for c in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*own, "query_id", "query_grp", "id", "grp", "score"]
        best, key, blocks, tile = None, [], [], None

        def found_by() -> pa.RecordBatch:
            best.settle()
            keys = [pa.repeat(x, len(best.row)) for x in key]
            return pa.RecordBatch.from_arrays([*keys, pa.array(best.id[best.row]), pa.array(best.grp[best.row]), pa.array(best.item), pa.array(best.group), pa.array(best.score)], names=names)

        for batch in batches:
            for n in range(batch.num_rows):
                here, q, v = (batch.column(len(own) + i)[n] for i in range(3))
                if here.as_py() != tile:
                    if best is not None:
                        yield found_by()
                    best, blocks, tile = None, [], here.as_py()
                if q.is_valid:
                    q, key = q.values, [batch.column(i)[n] for i in range(len(own))]
                    blocks.append((q.field("id").to_numpy(zero_copy_only=False), q.field("grp").to_numpy(zero_copy_only=False), _matrix(q)))
                    continue
                if best is None:
                    if not blocks:  # a part without queries
                        continue
                    best, blocks = _Best(blocks, k, least, other_group), []
                v = v.values
                items = v.field("items")
                flat = items.flatten()
                best.pass_by(_matrix(v), items.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), flat.field("id").to_numpy(zero_copy_only=False), flat.field("grp").to_numpy(zero_copy_only=False))
        if best is not None:
            yield found_by()

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "query_id long, query_grp long, id long, grp long, score double"])
    near = tiles.select(*own, F.xxhash64(*tile).alias("_tile"), "q", "v").mapInArrow(run, schema)
    order = Window.partitionBy(*own, "query_id").orderBy(F.round("score", 9).desc(), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def no_group() -> Column:
    return F.lit(0).cast("long").alias("grp")
