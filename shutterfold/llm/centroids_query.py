"""op12: ten rounds of exact whole-number k-means over all usable embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids

K, ROUNDS = 8, 10


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), k=K, rounds=ROUNDS)


def _assigned(number: int) -> str:
    """Every vector's nearest centroid of ``c{number}``."""
    return f"""a{number} AS MATERIALIZED (
  SELECT r, arg_min(k, d * {K} + k) AS cluster, min(d) AS distance FROM (
    SELECT v.r, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{number} c
  ) GROUP BY r)"""


def _moved(number: int) -> str:
    """Centroids after a round; floor division of sums, and empty ones stay."""
    return f"""s{number} AS (
  SELECT cluster, i, sum(e) AS s, count(*) AS n FROM (
    SELECT a.cluster, unnest(v.x) AS e, unnest(range(1, 65)) AS i FROM a{number} a JOIN v ON v.r = a.r
  ) GROUP BY cluster, i), c{number + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{number} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{number} GROUP BY cluster
  ) m ON m.cluster = c.k)"""


def _oracle() -> str:
    steps = ", ".join(f"{_assigned(i)}, {_moved(i)}" for i in range(ROUNDS))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT {K})
), {steps}, {_assigned(ROUNDS)}
SELECT v.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.r = a.r JOIN c{ROUNDS} c ON c.k = a.cluster
"""


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}
ORACLES = {"op12_centroid_clustering": _oracle()}
