"""Layers, crossings and places of graphs."""

import random

import pytest

from folioforge.operators import layout, retrieval


def graph(seed, n=60, m=90):
    r = random.Random(seed)
    nodes = [f"n{k:03d}" for k in range(n)]
    return nodes, [tuple(r.sample(nodes[: n - 8], 2)) for _ in range(m)]


@pytest.mark.parametrize("seed", range(6))
def test_layers_and_crossings(seed):
    nodes, links = graph(seed)
    edges = layout._acyclic(nodes, links)
    assert {frozenset(e) for e in edges} == {frozenset(e) for e in links}
    layer = layout.layers_of(nodes, edges)
    assert all(layer[a] < layer[b] for a, b in edges)
    assert all(k == 0 or any(layer[a] == k - 1 for a, b in edges if b == n) for n, k in layer.items())
    order, cut, begin = layout.ordered(layer, edges)
    of = {n: k for k, row in enumerate(order) for n in row}
    assert all(of[b] - of[a] == 1 for a, b in cut) and sorted(n for row in order for n in row if isinstance(n, str)) == nodes
    assert layout.crossings(order, cut) <= begin


def test_crossings_are_counted():
    assert layout.crossings([["a", "b"], ["c", "d"]], [("a", "d"), ("b", "c")]) == 1
    assert layout.crossings([["a", "b", "c"], ["x", "y", "z"]], [(p, q) for p in "abc" for q in "xyz"]) == 9


def test_places_do_not_overlap_and_are_equal_on_reruns():
    nodes, links = graph(3)
    got = layout.places(nodes, links)
    shuffled = nodes[:]
    random.Random(1).shuffle(shuffled)
    assert layout.places(shuffled, links[::-1]) == got and set(got) == set(nodes)
    at = list(got.values())
    assert all(abs(a[0] - b[0]) >= layout.WIDTH or abs(a[1] - b[1]) >= layout.HEIGHT for i, a in enumerate(at) for b in at[:i])
    alone = [n for n in nodes if all(n not in e for e in links)]
    bottom = max(y for n, (_, y) in got.items() if n not in alone) + layout.HEIGHT
    assert len(alone) >= 8 and all(got[n][1] >= bottom + layout.LAYER_GAP for n in alone)
    assert layout.places(["a", "b", "c", "d", "e"], []) == {n: (30 + i % 3 * 262, 30 + i // 3 * 108) for i, n in enumerate("abcde")}


def test_graphs_side_by_side(spark):
    nodes, links = graph(5, 30, 30)
    both = spark.createDataFrame([(o, n) for o in ("a", "b", None) for n in nodes], "owner_id string, node_id string")
    ends = spark.createDataFrame([(o, *e) for o in ("a", None) for e in links] + [("b", "n001", "unknown")], "owner_id string, left_node_id string, right_node_id string")
    got = {}
    for r in layout.layered_layout(both, ends).collect():
        got.setdefault(r.owner_id, {})[r.node_id] = (r.x, r.y)
    assert got["a"] == got[None] == layout.places(nodes, links) and got["b"] == layout.places(nodes, [])
    with pytest.raises(ValueError, match="more than"):
        layout.layered_layout(both, ends, most=20)


def test_words_of_scripts_without_blanks(spark):
    rows = [("a", "東京都庁の場所"), ("b", "京都の寺"), ("c", "서울에서 만나요"), ("d", "Plain words 東 カタカナ"), ("e", None), ("f", "학교 도서관")]
    texts = spark.createDataFrame(rows, "chunk_id string, text string")
    got = {r.chunk_id: r.t for r in texts.select("chunk_id", retrieval.tokens(texts["text"]).alias("t")).collect()}
    assert got["a"] == ["東京", "京都", "都庁", "庁の", "の場", "場所"] and got["d"] == ["plain", "words", "東", "カタ", "タカ", "カナ"]
    assert got["c"] == ["서울에서", "서울", "만나요"] and got["f"] == ["학교", "도서관"] and got["e"] is None
    find = lambda q: [r.chunk_id for r in retrieval.bm25_search(retrieval.postings(texts, query=q), texts, q).collect()]
    assert find("東京")[0] == "a" and find("서울") == ["c"] and find("서울은") == ["c"] and find("words") == ["d"]
