import numpy as np
from pyspark.sql import functions as F

from earshot.operators.metric_index import BallIndex, nearest_in_index


def brute(vectors, centroids):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return 1.0 - unit(vectors) @ unit(centroids).T


def clustered(rng, n, width, middles):
    return middles[rng.integers(0, len(middles), n)] + 0.15 * rng.normal(size=(n, width))


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(1)
    for n, width, spread in ((1, 3, False), (2, 3, False), (700, 5, False), (3000, 16, True)):
        middles = rng.normal(size=(40, width))
        cents = clustered(rng, n, width, middles) if spread else rng.normal(size=(n, width))
        vectors = clustered(rng, 400, width, middles) if spread else rng.normal(size=(400, width))
        cents[rng.integers(0, n, n // 5)] = cents[0]  # equal centroids
        vectors[:20] = cents[rng.integers(0, n, 20)] * 3.0
        if n > 100:
            cents[7] = 0.0
            vectors[30] = 0.0
        found, distance, seen = BallIndex(cents).nearest(vectors)
        want = brute(vectors, cents)
        assert np.allclose(distance, want.min(axis=1), atol=1e-9)
        # of equal centroids the first
        assert (found == [np.flatnonzero(row <= row.min() + 1e-12)[0] for row in want]).all()
        if spread:
            assert seen < 0.3 * want.size


def test_a_hundred_thousand_centroids(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(300, 24))
    cents, vectors = clustered(rng, 100_000, 24, middles).round(4), clustered(rng, 60, 24, middles).round(4)
    table = spark.createDataFrame([(f"s{k:06d}", v.tolist()) for k, v in enumerate(cents)], "speaker string, centroid array<double>")
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id int, emb array<double>")
    got = nearest_in_index(rows, table, "speaker", "emb")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 3000 and "Join" not in plan and "Aggregate" not in plan
    want = brute(vectors, cents)
    for r in got.collect():
        assert r.nearest == f"s{want[r.id].argmin():06d}" and abs(r.distance - want[r.id].min()) < 1e-9


def test_odd_rows(spark):
    cents = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (5, None)], "k int, centroid array<double>")
    rows = spark.createDataFrame([(0, [2.0, 0.0]), (1, None), (2, [1.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "id int, emb array<double>")
    got = {r.id: (r.nearest, r.distance) for r in nearest_in_index(rows, cents, "k", "emb").collect()}
    assert got == {0: (1, 0.0), 1: (None, None), 2: (None, None), 3: (1, 1.0), 4: (1, 1.0)}
    empty = nearest_in_index(rows, cents.filter("k = 9"), "k", "emb")
    assert empty.filter(F.col("nearest").isNotNull() | F.col("distance").isNotNull()).count() == 0 and empty.count() == 5
