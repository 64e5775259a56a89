import math

import numpy as np

from graphloom.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n string"


def brute(rows):
    ok = lambda v, y: y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, up, k = len(rows), list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    unit = [np.array(v, np.float32).astype(np.float64) if ok(v, y) else None for _, v, y in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                k[i] += 1
                k[j] += 1
                up[root(i)] = root(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, k[i], low.get(root(i)), d == low.get(root(i))) for i, (d, _, _) in enumerate(rows)), key=str)


def found(spark, rows, **more):
    d = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in hnsw.near_duplicates(d, **more).collect()), key=str)


def cloud(seed, n=300, dim=16):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((12, dim))
    v = [base[rnd.integers(12)] + rnd.standard_normal(dim) * rnd.choice([0.02, 0.25, 1.0]) for _ in range(n)]
    return [(i, [float(x) for x in row], int(rnd.integers(2))) for i, row in enumerate(v)]


def test_against_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(spark, rows) == brute(rows)
    rows = cloud(1)
    assert found(spark, rows) == brute(rows) == found(spark, rows, shard=40) == found(spark, rows, shard=40, chunk=30)


def test_awkward_rows(spark):
    v, w = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0]
    rows = [(1, v, 0), (1, v, 0), (2, v, 0), (3, v, 1), (4, [2.0, 0.0, 0.0], 0), (5, w, 0), (6, v, None), (7, None, 0), (8, [0.0, 0.0, 0.0], 0), (9, [1.0, None, 0.0], 0), (10, [float("nan"), 1.0, 0.0], 0), (11, [float("inf"), 1.0, 0.0], 0), (None, w, 0), (12, [], 0), (13, [1.0, 0.0], 0), (14, [0.0, 1.0, 0.0], 0), (None, [0.0, 0.0, 1.0], 0)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_large_cluster_is_all_reached():
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.standard_normal(32) + 0.05 * rnd.standard_normal((900, 32)), rnd.standard_normal((900, 32))])
    i, j = hnsw.links_between(x, x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(i) >= 0.995 * int((u @ u.T >= 0.93).sum())
