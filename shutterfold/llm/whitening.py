"""Embedding whitening by a tiled covariance.

Vectors become whole numbers ``x = floor(1024 * c) + 100000``.  Two passes
give the number of vectors, their sums and the covariance; the second cuts runs
of rows into column blocks and shuffles the blocks by row block.  The task that
has all column blocks of a row block multiplies each pair of them, the tile keys
(a, b) with a <= b, and adds the products tile by tile; Spark adds the tasks'
tiles, and the driver assembles ``dims x dims`` numbers and decomposes them.

Products are exact: entries are differences from the rounded mean, halved into
16-bit parts whose products sum exactly in double precision, and the totals are
whole numbers of any size.  The covariance is then ``(n * T - D D') / n**2`` with
T the summed products and D the sums of the differences, rounded once.  It does
not depend on how rows are dealt to tasks.

A component's vector has unit length and its largest entry is positive.
Components without variance (eigenvalue at rounding level of the largest one)
can't be whitened and have no rows; there are fewer of them than asked for when
vectors have fewer entries.  ``deviation`` is exact as ``decimal(38,0)``.

Vectors that are null or hold null or non-finite entries are left out.  Vectors
of one length are needed; where lengths differ, those of the most frequent one
count (of equally frequent ones the shorter), and the others are left out like
unusable rows.  Repeated rows count and are returned each time; ids may be null.
Without usable vectors, or without any variance, there are no rows.  Scaled
components of 2**27 or more are an error.  Only the id and the results are
returned, whatever the other columns are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterfold.operators.lineage import stored

from . import vectors

SHIFT = 100_000
WIDTH = 16
ROWS = 4096
#: The driver holds a few matrices of dims x dims.
MAX_DIMS = 4096
_HALF = 1 << 16
PARTS = ("high", "mid", "low")


def _summed(df: DataFrame, task, parts: tuple[str, ...], *keys: str) -> DataFrame:
    """Adds the arrays named ``parts`` that tasks emit, position by position, without overflow."""
    schema = ", ".join([*(f"{k} int" for k in keys), *(f"{p} array<bigint>" for p in parts)])
    each = df.mapInArrow(task, schema).select(*keys, F.posexplode(F.arrays_zip(*parts)).alias("at", "part"))
    return each.groupBy(*keys, "at").agg(*(F.sum(F.col(f"part.{p}").cast("decimal(38,0)")).alias(p) for p in parts))


def _sums(x: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and their sum."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, np.int64)
        for batch in batches:
            rows = vectors.unpacked(batch["x"], dims, np.int32)
            total[0] += len(rows)
            total[1:] += rows.sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["total"])

    found = {r["at"]: int(r["total"]) for r in _summed(x.select("x"), task, ("total",)).collect()}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(dims)]


def column_blocks(x: DataFrame, dims: int, middle: np.ndarray, width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """``row_block long, block int, part binary``: ``width`` columns of at most ``rows`` rows, less ``middle``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            found = vectors.unpacked(batch["x"], dims, np.int32) - middle
            for lo in range(0, len(found), rows):
                here = found[lo : lo + rows].astype(np.int32)
                parts = [np.ascontiguousarray(here[:, at : at + width]).tobytes() for at in range(0, dims, width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
                    ["row_block", "block", "part"],
                )
                number += 1

    return x.select("x").mapInArrow(cut, "row_block bigint, block int, part binary")


def products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a' b`` of whole numbers below 2**31 in three exact parts: times 2**32, times 2**16, and the rest."""
    (ah, al), (bh, bl) = ((np.floor_divide(m, _HALF).astype(np.float64), (m % _HALF).astype(np.float64)) for m in (a, b))
    return tuple(p.astype(np.int64) for p in (ah.T @ bh, ah.T @ bl + al.T @ bh, al.T @ bl))


def _tiles(blocks: DataFrame, dims: int, width: int) -> DataFrame:
    """Sums of products by tile key and position."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        at, parts = None, []

        def add() -> None:
            for a, one in enumerate(parts):
                for b in range(a, len(parts)):
                    found = np.array([p.ravel() for p in products(one, parts[b])])
                    tiles[a, b] = tiles[a, b] + found if (a, b) in tiles else found

        for batch in batches:
            for row_block, block, part in zip(batch["row_block"].to_pylist(), batch["block"].to_pylist(), batch["part"]):
                if row_block != at:
                    add()
                    at, parts = row_block, []
                columns = min(width, dims - block * width)
                parts.append(np.frombuffer(part.as_buffer(), np.int32).reshape(-1, columns).astype(np.int64))
        add()
        for (a, b), sums in tiles.items():
            longs = [pa.array([s], pa.list_(pa.int64())) for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), *longs], ["a", "b", *PARTS])

    dealt = blocks.repartition("row_block").sortWithinPartitions("row_block", "block")
    return _summed(dealt, multiply, PARTS, "a", "b")


def covariance(x: DataFrame, dims: int, n: int, sums: list[int], width: int = WIDTH, rows: int = ROWS) -> np.ndarray:
    """Covariance (divisor n) of the packed whole-number rows ``x``, each entry rounded once."""
    middle = np.array([s // n for s in sums], np.int64)
    left = np.array([s % n for s in sums], object)
    found = _tiles(column_blocks(x, dims, middle, width, rows), dims, width)
    text = lambda name: F.array_join(F.transform("entries", lambda e: e[name].cast("string")), ",").alias(name)
    by_tile = found.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("at", *PARTS))).alias("entries"))  # width**2 of them
    out = np.zeros((dims, dims))
    for r in by_tile.select("a", "b", *map(text, PARTS)).collect():
        rows_of, columns_of = (slice(r[x] * width, min(dims, (r[x] + 1) * width)) for x in "ab")
        high, mid, low = (np.array(list(map(int, r[p].split(","))), object) for p in PARTS)
        total = (high * (_HALF * _HALF) + mid * _HALF + low).reshape(out[rows_of, columns_of].shape)
        exact = n * total - np.outer(left[rows_of], left[columns_of])
        out[rows_of, columns_of] = (exact / (n * n)).astype(float)
        out[columns_of, rows_of] = out[rows_of, columns_of].T
    return out


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; without those at rounding level."""
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    used = values > max(values.max(initial=0.0), 0.0) * len(v) * np.finfo(float).eps
    values, axes = values[used], axes[:, used]
    if not len(values):
        return values, axes
    return values, axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int] | np.ndarray:
    """Exact sums over the entries of ``(n * x - sums) ** 2``."""
    middle = np.array([s // n for s in sums], np.int64)
    left, off = np.array([s % n for s in sums], object), x - middle
    most = n * (int(np.abs(off).max(initial=0)) + 1)
    if most * most * max(1, x.shape[1]) < 1 << 63:
        return ((off * n - left.astype(np.int64)) ** 2).sum(axis=1)
    return ((off.astype(object) * n - left) ** 2).sum(axis=1).tolist()


def _identity_error(x: DataFrame, dims: int, n: int, projected: Callable[[np.ndarray], np.ndarray]) -> float:
    """Largest absolute entry of the covariance of what ``projected`` makes of the rows, minus the identity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = 0.0, 0.0
        for batch in batches:
            w = projected(vectors.unpacked(batch["x"], dims, np.int32))
            first, second = first + w.sum(axis=0), second + w.T @ w
        if np.ndim(first):
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second.ravel()])], pa.list_(pa.float64()))], ["sums"])

    each = x.select("x").mapInArrow(task, "sums array<double>").select(F.posexplode("sums").alias("at", "part"))
    found = {r["at"]: r["total"] for r in each.groupBy("at").agg(F.sum("part").alias("total")).collect()}
    flat = np.array([found[i] for i in range(len(found))]) / n
    k = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    mean, second = flat[:k], flat[k:].reshape(k, k)  # the projections are centred already; what rounding left of their mean goes too
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """One row for each usable vector and component: ``key, component int, n long, deviation decimal(38,0), whitened, explained, identity_error double``."""
    kind = df.schema[key].dataType.simpleString()
    usable = df.where(vectors.finite(vector) & (F.size(vector) > 0)).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    common = usable.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = common[0]["dims"] if common else 0
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries; the covariance of at most {MAX_DIMS} is assembled on the driver")

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.scaled(vectors.matrix(batch["v"], dims)) + SHIFT
            yield pa.RecordBatch.from_arrays([batch["key"], vectors.packed(x.astype(np.int32))], ["key", "x"])

    x = stored(usable.where(F.size("v") == dims).mapInArrow(scaled, f"key {kind}, x binary"))
    n, sums = _sums(x, dims) if dims else (0, [])
    v = covariance(x, dims, n, sums, width, rows) if n else np.zeros((dims, dims))
    values, axes = principal(v, components)
    k = len(values)
    if k == 0:
        return x.where("false").selectExpr(
            f"key AS `{key}`", "1 AS component", "0L AS n", "CAST(0 AS decimal(38,0)) AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error"
        )
    turn = axes / np.sqrt(values)
    mean = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])

    def projected(found: np.ndarray) -> np.ndarray:
        return (found - mean[0] - mean[1]) @ turn

    error = _identity_error(x, dims, n, projected)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vectors.unpacked(batch["x"], dims, np.int32).astype(np.int64)
            exact = deviations(found, n, sums)
            exact = pa.array(exact, pa.int64()).cast(pa.decimal128(38, 0)) if isinstance(exact, np.ndarray) else pa.array(exact, pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch["key"], exact, pa.array(list(projected(found)), pa.list_(pa.float64()))], ["key", "deviation", "w"])

    shares = F.array(*(F.lit(float(e / np.trace(v))) for e in values))
    return x.mapInArrow(task, f"key {kind}, deviation decimal(38,0), w array<double>").select(
        "key", "deviation", F.posexplode("w").alias("at", "whitened")
    ).select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
