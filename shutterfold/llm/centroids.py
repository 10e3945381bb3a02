"""Exact whole-number k-means whose distances are screened by block norms.

Vectors become whole numbers.  Each is stored with the Euclidean norms of its
blocks of components (taken about one fixed origin), a compressed vector of a
few numbers.  By Cauchy-Schwarz, ``|x - c|**2 >= sum over blocks of
(|x_b| - |c_b|)**2``, so the norms of a vector and of a centroid bound their
distance from below.  The centroid of the smallest bound is measured first;
of the others only those whose bound doesn't exceed that distance are measured,
in whole numbers.  Bounds are loosened by more than their rounding errors, so
the nearest centroid, and the smaller number on ties, is always the exact one.

A round is one pass: every task adds up the vectors of each centroid, Spark
adds the tasks' sums, and the driver gets ``k`` rows of ``dims`` totals.  No
vector is shuffled, so a third of all rows being equal changes nothing.

Vectors that are null, of another length, or with null or non-finite entries
are left out.  First centroids are the ``k`` vectors with the least SHA-256 of
``seed`` and id (fewer vectors: fewer centroids); rows without an id come last
there and are clustered like all others; rows that share an id are ordered by
their components.  Repeated rows each get a row.  An empty table, or one without
usable vectors, gives no rows.  A component of 2**27 or more after scaling is an
error, for its distances don't fit in 64 bits; so is a sum of distances beyond
them.  Only the id and the results are returned, whatever the other columns are
called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterfold.operators.lineage import stored

from . import vectors

BLOCK = 8
#: More than the relative rounding error of a bound, which is a few units of 2**-53.
SLACK = 1e-12
PART = 1 << 32


def block_norms(rows: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Norm of each run of ``block`` components."""
    starts = np.arange(0, rows.shape[1], block)
    squares = rows.astype(np.float64) ** 2
    return np.sqrt(np.add.reduceat(squares, starts, axis=1)) if len(rows) else np.empty((0, len(starts)))


@dataclass(frozen=True)
class Centroids:
    """Centroids with their block norms about ``origin``."""

    rows: np.ndarray
    origin: np.ndarray

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid, its squared distance, and how many exact distances that took."""
        own = block_norms(self.rows - self.origin)
        mine, theirs = (norms**2).sum(axis=1)[:, None], (own**2).sum(axis=1)[None, :]
        bound = mine + theirs - 2 * norms @ own.T - SLACK * (mine + theirs) - 1
        cluster = bound.argmin(axis=1)
        best = ((x - self.rows[cluster]) ** 2).sum(axis=1)
        first, measured = cluster.copy(), len(x)
        for number, centroid in enumerate(self.rows):
            at = np.flatnonzero((bound[:, number] <= best) & (first != number))
            if len(at):
                measured += len(at)
                distance = ((x[at] - centroid) ** 2).sum(axis=1)
                closer = (distance < best[at]) | ((distance == best[at]) & (number < cluster[at]))
                best[at[closer]], cluster[at[closer]] = distance[closer], number
        return cluster, best, measured


def _prepared(df: DataFrame, key: str, vector: str, dims: int, scale: int, origin: np.ndarray) -> DataFrame:
    """Whole-number vectors and their block norms, stored once for all rounds."""
    blocks = len(range(0, dims, BLOCK))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.scaled(vectors.matrix(batch["v"], dims), scale)
            norms = block_norms(x - origin).reshape(len(x), blocks)
            yield pa.RecordBatch.from_arrays([batch["key"], vectors.packed(x.astype(np.int32)), vectors.packed(norms)], ["key", "x", "norms"])

    kind = df.schema[key].dataType.simpleString()
    return stored(df.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInArrow(rows, f"key {kind}, x binary, norms binary"))


def _read(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    x = vectors.unpacked(batch["x"], dims, np.int32).astype(np.int64)
    return x, vectors.unpacked(batch["norms"], len(range(0, dims, BLOCK)), np.float64)


def _totals(prepared: DataFrame, centroids: Centroids) -> dict[int, list[int]]:
    """For every centroid with vectors: their number, the upper and lower parts of their distances' sum, and their sum."""
    k, dims = centroids.rows.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 3), np.int64)
        for batch in batches:
            x, norms = _read(batch, dims)
            cluster, distance, _ = centroids.nearest(x, norms)
            row = np.column_stack([np.ones(len(x), np.int64), distance // PART, distance % PART, x])
            for number in range(k):
                total[number] += row[cluster == number].sum(axis=0)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "sums"])

    found = (
        prepared.select("x", "norms")
        .mapInArrow(sums, "cluster int, sums array<bigint>")
        .select("cluster", F.posexplode("sums").alias("at", "part"))
        .groupBy("cluster", "at")
        .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
        .collect()  # k * (dims + 3) numbers
    )
    totals: dict[int, list[int]] = {}
    for r in found:
        totals.setdefault(r["cluster"], [0] * (dims + 3))[r["at"]] = int(r["total"])
    return totals


def _long(total: int) -> int:
    if total >= 1 << 63:
        raise OverflowError("a sum of squared distances doesn't fit in 64 bits")
    return total


def clusters(
    df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:", key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``key, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string`` of every usable vector."""
    usable = df.where(vectors.finite(vector) & (F.size(vector) == dims)).select(key, vector)
    order = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    first = usable.orderBy(order.asc_nulls_last(), vector).limit(k).select(vector).collect()
    rows = vectors.scaled(np.array([r[0] for r in first], np.float64).reshape(len(first), dims), scale)
    origin = rows.sum(axis=0) // max(1, len(rows))
    prepared = _prepared(usable, key, vector, dims, scale, origin)
    if not len(rows):
        return prepared.selectExpr(
            f"key AS `{key}`", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256"
        )
    for _ in range(rounds):
        rows = rows.copy()
        for number, (n, _, _, *total) in _totals(prepared, Centroids(rows.copy(), origin)).items():
            rows[number] = [t // n for t in total]
    last = Centroids(rows, origin)
    totals = _totals(prepared, last)
    inertia = [_long(totals[i][1] * PART + totals[i][2]) if i in totals else 0 for i in range(len(rows))]
    digests = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows.tolist()]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = last.nearest(*_read(batch, dims))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["key", "cluster", "distance"])

    kind = df.schema[key].dataType.simpleString()
    of_cluster = lambda values: F.array(*map(F.lit, values))[F.col("cluster")]
    return prepared.mapInArrow(assigned, f"key {kind}, cluster int, distance bigint").select(
        F.col("key").alias(key),
        "cluster",
        "distance",
        of_cluster(inertia).cast("long").alias("cluster_inertia"),
        F.lit(_long(sum(inertia))).cast("long").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
    )
