"""Matches of segments after edits, against those of all segments anew."""

import random

from folioforge.operators import nearest, semantic

SCHEMA = "owner_id string, embedding_model string, node_id long, segment_id long, embedding array<double>"


def plain(df):
    return sorted((r.owner_id, r.segment, r.node, r.other, r.other_node, round(r.raw, 9)) for r in df.collect())


def test_refreshed_matches_equal_new_ones(spark, monkeypatch):
    r = random.Random(11)
    vector = lambda: [r.gauss(0, 1) for _ in range(5)]
    rows = {k: ("p" if k % 7 == 0 else "o", "m", k // 4, k, vector()) for k in range(160)}
    frame = lambda: spark.createDataFrame(list(rows.values()), SCHEMA).cache()
    now = frame()
    matches = semantic.similar_segments(now, 0.2, 6).cache()
    asked = []
    real = nearest.nearest
    monkeypatch.setattr(semantic, "nearest", lambda q, v, *a, **b: asked.append((q.count(), v.count())) or real(q, v, *a, **b))
    for step in range(3):
        before = now
        for k in r.sample(sorted(rows), 4):
            del rows[k]
        for k in r.sample(sorted(rows), 3):
            rows[k] = (*rows[k][:4], vector())
        rows[1000 + step] = ("o", "m", 500 + step, 1000 + step, vector())
        k = r.choice(sorted(rows))
        rows[k] = (*rows[k][:2], 900, *rows[k][3:])  # another node
        now = frame()
        asked.clear()
        got = semantic.refreshed_segments(matches, before, now, 0.2, 6).cache()
        monkeypatch.setattr(semantic, "nearest", real)
        whole = semantic.similar_segments(now, 0.2, 6)
        assert plain(got) == plain(whole), step
        (again, _), (_, fresh) = asked
        assert fresh <= 5 and again < now.count() / 2
        monkeypatch.setattr(semantic, "nearest", lambda q, v, *a, **b: asked.append((q.count(), v.count())) or real(q, v, *a, **b))
        matches = spark.createDataFrame(got.collect(), got.schema)
    nodes = now.groupBy("node_id").count().withColumnRenamed("count", "segment_count")
    order = nodes.selectExpr("node_id", "node_id AS position")
    links = lambda m: sorted(map(str, semantic.rebuild_links(semantic.link_candidates(m, nodes, model="other"), order).select("link_id", "matched_pair_count").collect()))
    assert links(matches) == links(whole)
