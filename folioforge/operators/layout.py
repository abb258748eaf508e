"""Places of a graph's nodes in layers from left to right; many graphs side by side, one a group.

Layers are longest paths from the nodes that nothing leads to; edges that would close a cycle count turned round. Long edges
are split by places in the layers between. The order within layers is improved by sweeps that sort by medians of the
neighbours, of which the one with the fewest crossings stays. Heights then follow the neighbours as far as order and
distance allow. Nodes without links stand in a grid below. Equal graphs get equal places on every run.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from statistics import mean, median_low

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.config import DEFAULTS

#: Size of a node, gaps between nodes of a layer and between layers, margin; steps and most columns of the grid.
WIDTH, HEIGHT, NODE_GAP, LAYER_GAP, MARGIN = 220, 74, 38, 90, 30
GRID_X, GRID_Y, GRID_COLUMNS = 262, 108, 4
SWEEPS = 12


def _acyclic(nodes: list[str], edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The edges with those turned round that lead back to where a walk came from; none twice."""
    after: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in sorted(set(edges)):
        if a != b:
            after[a].append(b)
    state, out = dict.fromkeys(nodes, 0), set()
    for root in nodes:
        stack = [(root, iter(after[root]))] if not state[root] else []
        while stack:
            node, rest = stack[-1]
            state[node] = 1
            step = next(rest, None)
            if step is None:
                state[node] = 2
                stack.pop()
            elif state[step] == 1:
                out.add((step, node))
            else:
                out.add((node, step))
                if not state[step]:
                    stack.append((step, iter(after[step])))
    return sorted(out)


def layers_of(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """The layer of each node: one more than the highest of those before it."""
    before: dict[str, list[str]] = {n: [] for n in nodes}
    after: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in edges:
        before[b].append(a)
        after[a].append(b)
    left, layer = {n: len(before[n]) for n in nodes}, dict.fromkeys(nodes, 0)
    ready = [n for n in nodes if not left[n]]
    for n in ready:  # grows while it is walked
        for b in after[n]:
            layer[b] = max(layer[b], layer[n] + 1)
            left[b] -= 1
            if not left[b]:
                ready.append(b)
    return layer


def crossings(order: list[list], edges: list[tuple]) -> int:
    """How many pairs of edges between neighbouring layers cross."""
    place = {n: i for row in order for i, n in enumerate(row)}
    of = {n: k for k, row in enumerate(order) for n in row}
    total = 0
    for k in range(len(order) - 1):
        seen: list[int] = []
        for _, b in sorted((place[a], place[b]) for a, b in edges if of[a] == k):
            total += len(seen) - bisect_right(seen, b)
            insort(seen, b)
    return total


def ordered(layer: dict[str, int], edges: list[tuple[str, str]]) -> tuple[list[list], list[tuple], int]:
    """(rows of each layer in order, edges cut at every layer, crossings before the sweeps); places between are pairs (edge, layer)."""
    order: list[list] = [[] for _ in range(max(layer.values(), default=-1) + 1)]
    for n, k in layer.items():
        order[k].append(n)
    cut: list[tuple] = []
    for a, b in edges:
        chain = [a, *(((a, b), k) for k in range(layer[a] + 1, layer[b])), b]
        for n in chain[1:-1]:
            order[n[1]].append(n)
        cut += zip(chain, chain[1:], strict=False)
    left: dict = {}
    right: dict = {}
    for a, b in cut:
        right.setdefault(a, []).append(b)
        left.setdefault(b, []).append(a)
    begin = crossings(order, cut)
    best, fewest = [list(r) for r in order], begin
    for sweep in range(SWEEPS):
        near, ways = (left, range(1, len(order))) if sweep % 2 == 0 else (right, range(len(order) - 2, -1, -1))
        for k in ways:
            place = {n: i for i, n in enumerate(order[k - 1 if near is left else k + 1])}
            now = {n: i for i, n in enumerate(order[k])}
            key = {n: median_low([place[m] for m in near[n]]) if n in near else now[n] for n in order[k]}
            order[k].sort(key=lambda n: (key[n], now[n]))  # noqa: B023
        if (found := crossings(order, cut)) < fewest:
            best, fewest = [list(r) for r in order], found
    return best, cut, begin


def heights(order: list[list], cut: list[tuple]) -> dict:
    """The top of each place: near the mean of its neighbours, in order, never closer than the gaps."""
    room = lambda n: HEIGHT + NODE_GAP if isinstance(n, str) else NODE_GAP
    near: dict = {}
    for a, b in cut:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    y: dict = {}
    for row in order:
        at = 0.0
        for n in row:
            y[n] = at
            at += room(n)
    for sweep in range(6):
        for row in order if sweep % 2 == 0 else reversed(order):
            wish = [mean(y[m] for m in near[n]) if n in near else y[n] for n in row]
            for i in range(1, len(row)):
                wish[i] = max(wish[i], wish[i - 1] + room(row[i - 1]))
            y.update(zip(row, wish, strict=True))
    low = min(y.values(), default=0.0)
    return {n: v - low for n, v in y.items()}


def places(nodes: list[str], links: list[tuple[str, str]]) -> dict[str, tuple[float, float]]:
    """(x, y) of the upper left corner of each node."""
    known = set(nodes)
    links = [(a, b) for a, b in links if a in known and b in known and a != b]
    linked = {n for pair in links for n in pair}
    inside = sorted(linked)
    edges = _acyclic(inside, links)
    layer = layers_of(inside, edges)
    order, cut, _ = ordered(layer, edges)
    y = heights(order, cut)
    out = {n: (MARGIN + layer[n] * (WIDTH + LAYER_GAP), MARGIN + y[n]) for n in inside}
    top = max((v[1] + HEIGHT for v in out.values()), default=0.0) + LAYER_GAP if out else MARGIN
    alone = sorted(known - linked)
    columns = min(GRID_COLUMNS, max(1, -int(-(len(alone) ** 0.5) // 1)))
    return out | {n: (MARGIN + i % columns * GRID_X, top + i // columns * GRID_Y) for i, n in enumerate(alone)}


def layered_layout(nodes: DataFrame, links: DataFrame, group: str = "owner_id", most: int = DEFAULTS.graph_nodes) -> DataFrame:
    """(group, node_id, x, y) for nodes(group, node_id) and links(group, left_node_id, right_node_id).

    A graph has at most `most` nodes, as `graph_view` leaves it; a larger one is an error. Links to other nodes count as none.
    """
    sizes = nodes.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    if not sizes.isEmpty():
        raise ValueError(f"a graph has more than {most} nodes")
    mine = nodes.select(F.col(group).alias("g"), F.col("node_id").cast("string").alias("node_id"))
    ends = links.select(F.col(group).alias("g"), F.col("left_node_id").cast("string").alias("a"), F.col("right_node_id").cast("string").alias("b"))

    def place(key: tuple, own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        found = places(own["node_id"].tolist(), list(zip(pairs["a"], pairs["b"], strict=True)))
        return pd.DataFrame([(key[0], n, float(x), float(y)) for n, (x, y) in found.items()], columns=["g", "node_id", "x", "y"])

    kind = mine.schema["g"].dataType.simpleString()
    return mine.groupBy("g").cogroup(ends.groupBy("g")).applyInPandas(place, f"g {kind}, node_id string, x double, y double").withColumnRenamed("g", group)
