import hashlib
import math
import random

import numpy as np

from braidwork.llm import hamerly


def plain(rows, k, rounds):
    """(vec_id, cluster, distance) of each row, and the centroids, by comparing all with all in Python integers."""
    kept = [(i, [max(-hamerly.LARGEST, min(hamerly.LARGEST, math.floor(256 * x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in start[:k]]
    d = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    for n in range(rounds + 1):
        of = [min((d(v, w), j) for j, w in enumerate(c)) for _, v in kept]
        if n < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, i) in zip(kept, of) if i == j]
                if own:
                    c[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, j, dist) for (i, _), (dist, j) in zip(kept, of)), key=repr), c


def vectors(r, n):
    middles = [[r.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [float(np.float32(m + r.gauss(0, 0.3))) for m in r.choice(middles)]) for i in range(n)]


def test_clusters_match_plain_rounds(spark):
    r = random.Random(1)
    rows = vectors(r, 300)
    rows += [(3, rows[3][1]), (500, [0.0] * 64), (501, [0.0] * 64), (502, [0.0] * 63), (503, None), (504, [math.nan] + [0.0] * 63), (505, [math.inf] + [0.0] * 63), (506, [None] + [0.0] * 63), (None, [0.25] * 64), (507, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS cluster", "1 AS v", "2 AS distance").repartition(5)
    found, centroids = hamerly.clusters(df, k=12)
    want, c = plain(rows, 12, 5)
    got = found.collect()
    assert sorted(((x.vec_id, x.cluster, x.distance) for x in got), key=repr) == want
    assert centroids == c
    assert sum(x.scans for x in got) < 5 * len(got)  # bounds spare full scans


def test_ties_go_to_the_smaller_number_and_large_values_stay_exact(spark):
    rows = [(i, [float(x)] * 64) for i, x in enumerate([0, 2, 1, 1, 4, 3, 1e30, -1e30, 400000.0, 400000.5])]
    found, centroids = hamerly.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, rounds=2)
    want, c = plain(rows, 4, 2)
    assert sorted(((x.vec_id, x.cluster, x.distance) for x in found.collect()), key=repr) == want and centroids == c


def test_fewer_vectors_than_centroids_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    found, centroids = hamerly.clusters(spark.createDataFrame([(1, [0.5] * 64)], schema))
    assert [(x.vec_id, x.cluster, x.distance) for x in found.collect()] == [(1, 0, 0)] and centroids == [[128] * 64]
    found, centroids = hamerly.clusters(spark.createDataFrame([], schema))
    assert found.count() == 0 and centroids == []


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert hamerly.op12_clusters(spark, str(tmp_path)).count() == 0
