"""Nearest search over lists: exact while narrow, measured recall beyond, equal vectors, several sizes."""

import random

import numpy as np
from pyspark.sql import functions as F

from folioforge.operators import nearest


def pairs(df):
    return {(r.query_id, r.id) for r in df.select("query_id", "id").collect()}


def rows_of(spark, name):
    e = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 10).alias("grp"), F.col("embedding").alias("vector"))


def test_recall_of_probes(spark):
    rows = rows_of(spark, "sf0.1")
    exact = pairs(nearest.nearest(rows, rows, 30, 0.1875, other_group=True))
    m = np.array([r.vector for r in rows.orderBy("id").collect()], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    group = np.arange(len(m)) // 10
    s[group[:, None] == group[None, :]] = -2
    order = np.argsort(-s, axis=1, kind="stable")[:, :30]
    assert exact == {(i, int(j)) for i in range(len(m)) for j in order[i] if s[i, j] >= 0.1875}
    got = pairs(nearest.nearest(rows, rows, 30, 0.1875, other_group=True, list_size=32))
    assert len(got & exact) >= 0.9 * len(exact)


def test_lists_of_vectors_with_structure_need_few_probes(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16))
    m = np.concatenate([c + 0.05 * r.normal(size=(30, 16)) for c in centres])
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(m)], "id long, grp long, vector array<float>")
    asked = rows.withColumn("_size", F.lit(16)).withColumn("wide", F.lit(True))
    found = nearest.centroids(rows.select(F.lit(16).alias("size"), "vector"), 60, 2000)
    held = nearest._routed(asked, found, 1).withColumn("list", F.col("lists")[0])
    assert nearest.probes_needed(asked, held, found, 10, ["_size"]) <= 10
    exact, got = (pairs(nearest.nearest(rows, rows, 10, list_size=n)) for n in (1000, 20))
    assert len(got & exact) >= 0.9 * len(exact) and len(exact) == 12_000


def test_equal_vectors_and_several_sizes(spark):
    r = random.Random(6)
    hot = [0.5, 0.25, -1.0]
    data = [(o, i, i // 3, hot if i % 2 else [r.gauss(0, 1) for _ in range(3)]) for o in ("a", None) for i in range(90)]
    data += [("a", 1000 + i, i, [r.gauss(0, 1) for _ in range(5)]) for i in range(20)] + [("b", 5, 1, [0.0, 0.0]), ("b", 6, 1, None)]
    rows = spark.createDataFrame(data, "owner string, id long, grp long, vector array<double>").where("owner IS NOT NULL").repartition(3)
    got = {}
    for x in nearest.nearest(rows, rows, 5, 0.0, ["owner"], other_group=True).collect():
        got.setdefault(x.query_id, {})[x.rank] = x.id
    data = [d for d in data if d[0] == "a"]
    for _, i, g, v in data:
        near = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for _, j, h, w in data if h != g and len(w) == len(v)]
        near = [j for s, j in sorted(near) if s <= 0][:5]
        assert [got.get(i, {}).get(k + 1) for k in range(len(near))] == near and len(got.get(i, {})) == len(near)


def test_no_cross_join(spark):
    rows = rows_of(spark, "sf0.001")
    plan = nearest.nearest(rows, rows, 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
