"""op12 against a plain k-means with Python integers, and its SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from shutterfold.llm import centroids, centroids_query, vectors

SCHEMA = "vec_id long, embedding array<float>, cluster string, x int"


def plain(rows, k=8, rounds=10, dims=64):
    """Sorted (id, cluster, distance, cluster inertia, inertia, digest)."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    places = [x for _, x in first[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(places))

    for _ in range(rounds):
        near = [nearest(x)[1] for _, x in kept]
        groups = [[x for (_, x), c in zip(kept, near) if c == j] for j in range(len(places))]
        places = [[sum(col) // len(g) for col in zip(*g)] if g else old for g, old in zip(groups, places)]
    last = [nearest(x) for _, x in kept]
    own = [sum(d for d, c in last if c == j) for j in range(len(places))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    return sorted(((i, c, d, own[c], sum(own), digest[c]) for (i, _), (d, c) in zip(kept, last)), key=str)


def sample(n=150, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 64))
    found = [(i, (middles[i % 5] + 0.3 * rng.normal(size=64)).tolist(), "c", 1) for i in range(n)]
    bad = [None, [], [0.5] * 63, [0.5] * 65, [None, *[0.5] * 63], [float("nan"), *[0.5] * 63], [float("-inf"), *[0.5] * 63], [None] * 64]
    odd = [(1000 + i, v, None, None) for i, v in enumerate(bad)]
    copies = [(2000 + i, [0.25] * 64, "c", 1) for i in range(40)]  # a large group of equal vectors
    return found + odd + copies + [(3, found[3][1], "c", 1), (3, [1.5] * 64, "c", 1), (None, [-0.5] * 64, "c", 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_all_rounds_equal_a_plain_model(spark, parts):
    rows = sample()
    got = centroids.clusters(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_sql_gives_the_same(spark, tmp_path):
    rows = [r for r in sample(60, 4) if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids_query.op12_centroid_clustering(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(centroids_query.ORACLES["op12_centroid_clustering"]).fetchall())


def test_few_no_and_tied_vectors(spark):
    few = [(1, [0.1, 0.2]), (2, [0.3, -0.2]), (3, [0.2, 0.0])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, centroids.clusters(frame(few), dims=2).collect())) == plain(few, dims=2)
    assert centroids.clusters(frame([]), dims=2).collect() == [] == centroids.clusters(frame([(1, None)]), dims=2).collect()
    same = [(i, [0.5, 0.5]) for i in range(20)]  # all centroids are equal: the smallest number wins, the others stay
    got = centroids.clusters(frame(same), dims=2).collect()
    assert {(r.cluster, r.distance) for r in got} == {(0, 0)} and sorted(map(tuple, got), key=str) == plain(same, dims=2)


def test_screening_is_exact_and_saves_distances():
    rng = np.random.default_rng(2)
    for spread, most in ((0.05, 0.4), (1.0, 1.0)):
        middles = rng.integers(-3000, 3000, (8, 64))
        x = middles[rng.integers(8, size=500)] + np.floor(spread * 1000 * rng.normal(size=(500, 64))).astype(np.int64)
        origin = middles.sum(axis=0) // 8
        cluster, distance, measured = centroids.Centroids(middles, origin).nearest(x, centroids.block_norms(x - origin))
        exact = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2)
        assert np.array_equal(cluster, exact.argmin(axis=1)) and np.array_equal(distance, exact.min(axis=1))
        assert measured <= most * exact.size
    large = rng.integers(-vectors.LIMIT + 1, vectors.LIMIT, (50, 64))
    found = centroids.Centroids(large[:8], large[0]).nearest(large, centroids.block_norms(large - large[0]))
    exact = ((large[:, None, :].astype(object) - large[None, :8]) ** 2).sum(axis=2)
    assert found[0].tolist() == exact.argmin(axis=1).tolist() and found[1].tolist() == exact.min(axis=1).tolist()


def test_components_that_do_not_fit_are_an_error():
    with pytest.raises(OverflowError):
        vectors.scaled(np.array([[1e30]]))
