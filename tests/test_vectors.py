import numpy as np

from plumbline.operators import vectors as V


def tables(spark):
    rng = np.random.default_rng(4)
    q = [("hot" if i % 3 else "x", i, rng.normal(size=5).tolist()) for i in range(90)]
    m = [("hot" if i % 2 else "x", i, rng.normal(size=5).tolist()) for i in range(70)]
    return (
        q,
        m,
        spark.createDataFrame(q, "category string, query_id long, vec array<double>"),
        spark.createDataFrame(m, "category string, memory_id long, vec array<double>"),
    )


def test_cells_give_the_nearest(spark, large):
    q, m, dq, dm = tables(spark)
    q, m = q + [("x", 900, [0.0] * 5)], m + [("x", 901, [0.0] * 5), ("hot", 902, m[0][2])]
    dq, dm = spark.createDataFrame(q, dq.schema), spark.createDataFrame(m, dm.schema)
    for sizes in ({}, {"pivots": 6, "query_block": 7, "memory_block": 5}, {"pivots": 1}):
        found = {}
        for r in sorted(V.top_similar(dq, dm, ["category"], 3, **sizes).collect(), key=lambda r: r["rank"]):
            found.setdefault(r["query_id"], []).append(r["memory_id"])
        unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
        for key, i, vec in q:
            near = sorted((-round(float(unit(vec) @ unit(v)), 12), j) for k, j, v in m if k == key)[:3]
            assert found[i] == [j for _, j in near]
    nearest = V.nearest_distance(dq, dm, ["category"], query_block=11, memory_block=6).collect()
    assert {r["query_id"]: r["memory_id"] for r in nearest} == {i: ids[0] for i, ids in found.items()}
    assert V.top_similar(dq, dm.where("memory_id < 0"), ["category"], 3).count() == 0


def test_far_cells_are_not_visited(spark):
    """Clusters far apart: a query visits its own; the result is that of brute force."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    centres = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    rows = [(int(i % 8), i, (centres[i % 8] + 0.02 * rng.normal(size=8)).tolist()) for i in range(400)]
    memory = spark.createDataFrame([(0, i, v) for _, i, v in rows], "g int, memory_id long, vec array<double>")
    asked = spark.createDataFrame([(0, i, (np.array(v) + 0.01).tolist()) for _, i, v in rows[:80]], "g int, query_id long, vec array<double>")
    out = V.top_similar(asked, memory, ["g"], 2, pivots=64)
    x = np.array([v for _, _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.query_id, r["rank"]): r.memory_id for r in out.collect()}
    for _, i, v in rows[:80]:
        y = np.array(v) + 0.01
        order = np.argsort(-(x @ (y / np.linalg.norm(y))), kind="stable")[:2]
        assert [got[i, 1], got[i, 2]] == order.tolist()
    cells = [(c, 10, 0.1) for c in range(4)]
    near = spark.createDataFrame([(cells, [0.1, 0.25, 0.9, 1.3])], "cells array<struct<_cell:int,_n:long,_r:double>>, away array<double>")
    ids = lambda k: [c["_cell"] for c in near.select(V.reachable(F.col("cells"), F.col("away"), k).alias("c")).first().c]
    assert ids(3) == [0, 1] and ids(15) == [0, 1] and ids(25) == [0, 1, 2] and ids(1000) == [0, 1, 2, 3]


def test_class_moments_match_numpy(spark):
    q, _, dq, _ = tables(spark)
    x = np.array([v for k, _, v in q if k == "hot"])
    want = np.cov(x.T, bias=True)
    for r in V.class_moments(dq).where("category = 'hot'").collect():
        assert abs(r["cov"] - want[r["i"], r["j"]]) < 1e-9
