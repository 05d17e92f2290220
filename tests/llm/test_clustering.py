import hashlib
import math
import random

import numpy as np
import pytest

from tallywright.llm import clustering, registry

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, dims=64, clusters=40, rounds=5):
    """Plain k-means in Python integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, g in groups.items():
            centroids[k] = [sum(x) // len(g) for x in zip(*g)]
    out = [(i, nearest(v)) for i, v in kept]
    by = {}
    for _, (d, k) in out:
        by[k] = by.get(k, 0) + d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), k, d, by[k], sum(by.values()), marks[k]) for i, (d, k) in out)


def run(spark, rows, tmp_path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in registry.op11_centroid_clustering(spark, str(tmp_path)).collect())


def vectors(n, seed=1, spread=0.1):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(7)]
    f = lambda x: float(np.float32(x))
    return [(i, [f(x + rng.gauss(0, spread)) for x in rng.choice(middles)]) for i in range(n)]


def test_query_matches_brute_force(spark, tmp_path):
    rows = vectors(300)
    rows += [(k, v) for k, (_, v) in enumerate(rows[:40])]  # repeated ids with the same vector
    rows += [(1000 + k, rows[0][1]) for k in range(200)]  # one vector with a third of the rows
    rows += [(None, rows[3][1]), (2000, None), (2001, []), (2002, rows[0][1][:63]), (2003, rows[0][1] + [0.0])]
    rows += [(2004 + k, [x, *rows[0][1][1:]]) for k, x in enumerate((None, float("nan"), float("inf"), float("-inf")))]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_ties_go_to_the_smaller_number(spark, tmp_path):
    """Few values a component: many vectors lie equally far from several centroids, and many centroids are equal."""
    rng = random.Random(4)
    rows = [(i, [rng.randrange(2) / 256.0 if d < 4 else 0.0 for d in range(64)]) for i in range(200)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_fewer_vectors_than_clusters_and_empty_tables(spark, tmp_path):
    few = vectors(5)
    assert run(spark, few, tmp_path / "few") == brute(few)
    assert run(spark, [], tmp_path / "none") == []
    assert run(spark, [(1, None), (2, [float("nan")] * 64)], tmp_path / "unfit") == []


def test_other_columns_do_not_clash(spark):
    df = spark.createDataFrame(vectors(50), SCHEMA).selectExpr("*", "1 as cluster", "2 as distance", "'x' as v", "3 as VEC_ID", "4 as n")
    found, _ = clustering.cluster(df)
    assert found.count() == 50 and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [1e30] * 64)], SCHEMA))


@pytest.mark.parametrize("dims", [1, 2, 8])
def test_walks_stop_early_and_are_exact(dims):
    rng = np.random.default_rng(dims)
    for values in (3, 50, 100_000):
        centroids, x = rng.integers(-values, values, (40, dims)), rng.integers(-values, values, (3000, dims))
        number, best, looked = clustering.Centroids(centroids).nearest(x)
        far = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
        assert (best == far.min(1)).all() and (number == far.argmin(1)).all()
        if values > 3 and dims < 8:
            assert looked.mean() < 30  # the threshold spares the rest


def test_far_values_and_lists_walked_to_the_end():
    top = clustering.MAX_COMPONENT
    centroids = np.array([[top] * 64, [-top] * 64, [top] * 64])
    number, best, looked = clustering.Centroids(centroids).nearest(np.array([[-top] * 64, [0] * 64, [top] * 64]))
    assert number.tolist() == [1, 0, 0] and best.tolist() == [0, 64 * top * top, 0] and looked.max() == 3
