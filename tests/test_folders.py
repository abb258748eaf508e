"""Walks from roots, long chains, and closures that are patched."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.operators import folders
from folioforge.sources.commits import Repository

SCHEMA = "id string, parent_id string"


def chain(n):
    return [(f"k{i}", f"k{i - 1}" if i else None) for i in range(n)]


def below(rows, roots):
    out = {r for r, _ in rows if r in roots}
    while more := {i for i, p in rows if p in out} - out:
        out |= more
    return out


def closure_of(rows):
    up, out = dict(rows), set()
    for i in up:
        a, d = i, 0
        while a in up:
            out.add((i, a, d))
            a, d = up[a], d + 1
    return out


def test_a_small_tree_beside_a_long_chain(spark, monkeypatch):
    rows = chain(5000) + [("r", None), ("s", "r"), ("t", "s"), ("u", "r")]
    tree = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    seen = []
    real = folders.stored
    monkeypatch.setattr(folders, "stored", lambda df, name: seen.append(name) or real(df, name))
    assert {r.id for r in folders.descendants(tree, spark.createDataFrame([("r",), ("nope",)], "id string")).collect()} == {"r", "s", "t", "u"}
    assert set(seen) == {"folder-level"} and len(seen) == 4  # levels of that tree, nothing of the chain
    deep = folders.descendants(tree, spark.createDataFrame([("k4000",)], "id string"))
    assert deep.count() == 1000 and "folder-pointers" in seen


def test_walks_equal_the_closure(spark, monkeypatch):
    r = random.Random(3)
    rows = [(f"f{i}", None if i < 2 or r.random() < 0.05 else f"f{r.randint(max(0, i - 4), i - 1)}") for i in range(60)] + [("o", "gone"), ("x", "y"), ("y", "x")]
    tree = spark.createDataFrame(rows, SCHEMA)
    for walk in (24, 2):
        monkeypatch.setattr(folders, "WALK", walk)
        roots = [f"f{r.randint(0, 59)}" for _ in range(3)] + ["x"]
        assert {x.id for x in folders.descendants(tree, spark.createDataFrame([(x,) for x in roots], "id string")).collect()} == below(rows, roots)
        moves = [(a, b) for a, _ in rows[:12] for b in ("f40", "f59", "f3", None, "gone", "o")]
        got = {(m.id, m.target): m.allowed for m in folders.can_move(tree, spark.createDataFrame(moves, "id string, target string")).collect()}
        inside = {(i, a) for i, a, _ in closure_of(rows[:-2])}
        assert got == {(a, b): (b, a) not in inside for a, b in moves}


def test_patched_closures_equal_new_ones(spark, tmp_path):
    r = random.Random(8)
    now = {f"f{i}": f"f{r.randint(0, i - 1)}" if i > 3 else None for i in range(60)}
    home = Repository(spark, f"file://{tmp_path}/r")
    with home.begin() as t:
        t.create("folder_closure", StructType.fromDDL("id string, ancestor string, distance int"), ["id", "ancestor"])
        t.rewrite("folder_closure", folders.ancestors(spark.createDataFrame(list(now.items()), SCHEMA)))
    for step in range(4):
        known, changed = {(i, a) for i, a, _ in closure_of(list(now.items()))}, set()
        for _ in range(4):  # moves, of trees within moved trees too
            a, b = r.sample(sorted(now), 2)
            if (b, a) not in {(i, x) for i, x, _ in closure_of(list(now.items()))}:
                now[a] = r.choice([b, None])
                changed.add(a)
        for k in range(3):
            now[f"new{step}-{k}"] = r.choice([*sorted(now), None])
            changed.add(f"new{step}-{k}")
        leaf = next(i for i in sorted(now) if i not in set(now.values()) and i not in changed)
        del now[leaf]
        changed.add(leaf)
        tree = spark.createDataFrame(list(now.items()), SCHEMA)
        before = home.at().read("folder_closure")
        expected = closure_of(list(now.items()))
        named = spark.createDataFrame([(c,) for c in changed], "id string")
        assert {tuple(x) for x in folders.patched(before, tree, named).collect()} == expected and known
        folders.commit_closure(home, tree, named)
        assert {tuple(x) for x in home.at().read("folder_closure").collect()} == expected
    gone, fresh = folders.patch(home.at().read("folder_closure"), tree, spark.createDataFrame([("f59",)], "id string"))
    assert fresh.count() <= 70 and gone.join(fresh, ["id", "ancestor"], "left_anti").isEmpty()


def test_roots_of_a_selection(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], SCHEMA)
    docs = spark.createDataFrame([("1", "c"), ("2", "d"), ("3", None)], "document_id string, folder_id string")
    f, d, roots = folders.deletion_targets(tree, docs, spark.createDataFrame([("a",), ("c",), ("d",)], "id string"))
    assert {x.id for x in f.collect()} == {"a", "b", "c", "d"} and {x.document_id for x in d.collect()} == {"1", "2"} and {x.id for x in roots.collect()} == {"a", "d"}
    with pytest.raises(ValueError, match="does not exist"):
        folders.deletion_targets(tree, docs, tree.select(F.lit("z").alias("id")))
