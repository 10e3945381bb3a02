"""op13 against numpy and Python integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterfold.llm import vectors, whitening, whitening_query

SCHEMA = "vec_id long, embedding array<float>, component string, key int"


def sample(n=200, dims=20, seed=1):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims))
    rows = [(i, v, "c", 1) for i, v in enumerate(mixed.tolist())]
    rows += [(1000 + i, [0.25] * dims, None, None) for i in range(n // 2)]  # a third of all rows are one vector
    bad = [None, [None] * dims, [float("nan")] * dims, [1.0] * (dims - 1) + [float("inf")], [1.0] * (dims - 1), []]
    return rows + [(2000 + i, v, "c", 1) for i, v in enumerate(bad)] + [(None, rows[0][1], "c", 1), rows[1]]


def whole(rows, dims):
    kept = [r for r in rows if r[1] is not None and len(r[1]) == dims and all(c is not None and math.isfinite(c) for c in r[1])]
    return [r[0] for r in kept], [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in r[1]] for r in kept]


@pytest.mark.parametrize(("width", "rows_a_block", "parts"), [(16, 4096, 2), (7, 13, 5)])
def test_every_column_equals_a_plain_model(spark, width, rows_a_block, parts):
    rows = sample()
    ids, x = whole(rows, 20)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = (np.array(x, object) * n - np.array(sums, object)).astype(float) / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    want = centred @ axes / np.sqrt(values)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts), width=width, rows=rows_a_block).orderBy("component").collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    dev = {i: sum((n * c - s) ** 2 for c, s in zip(r, sums)) for i, r in zip(ids, x)}
    by = {}
    for r in got:
        assert int(r["deviation"]) == dev[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-9)
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], set()).add(r["whitened"])
    sign = [np.sign(next(iter(by[0][c + 1])) * want[ids.index(0), c]) for c in range(8)]
    for i, w in zip(ids, want):
        for c in range(8):
            assert all(z == pytest.approx(w[c] * sign[c], abs=1e-8) for z in by[i][c + 1])
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_covariance_is_exact_and_does_not_depend_on_the_deal(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-vectors.LIMIT + 1, vectors.LIMIT, (40, 9)), rng.integers(99_999, 100_001, (300, 9))])
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    frame = spark.createDataFrame([(r.astype(np.int32).tobytes(),) for r in x], "x binary")
    ways = [whitening.covariance(frame.repartition(p), 9, n, sums, width=w, rows=r) for p, w, r in ((1, 4, 50), (6, 16, 4096), (3, 1, 7))]
    assert np.array_equal(ways[0], ways[1]) and np.array_equal(ways[0], ways[2]) and np.array_equal(ways[0], ways[0].T)
    big = x.astype(object)
    for i, j in ((0, 0), (2, 7), (8, 3)):
        exact = sum(Fraction(int(a) * n - sums[i]) * (int(b) * n - sums[j]) for a, b in zip(big[:, i], big[:, j])) / n**3
        assert ways[0][i, j] == float(exact)


def test_column_blocks_meet_by_row_block(spark):
    x = np.arange(10 * 5, dtype=np.int32).reshape(10, 5)
    frame = spark.createDataFrame([(r.tobytes(),) for r in x], "x binary").coalesce(1)
    got = whitening.column_blocks(frame, 5, np.zeros(5, np.int64), width=2, rows=4).groupBy("row_block").agg(F.count("*").alias("blocks"), F.sum(F.length("part")).alias("size")).orderBy("row_block").collect()
    assert [(r.blocks, r["size"]) for r in got] == [(3, 80), (3, 80), (3, 40)]


def test_deviations_of_any_size():
    x = np.array([[1 << 27, 0], [-(1 << 27), 5]], np.int64)
    n = 1 << 31
    sums = [n * 3 + 1, -7]
    assert list(whitening.deviations(x, n, sums)) == [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
    assert list(whitening.deviations(x[:0], n, sums)) == []


def test_no_vectors_no_variance_and_few_entries(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]):
        assert whitening.whiten(frame(rows)).collect() == []
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]  # one direction only
    got = whitening.whiten(frame(line)).orderBy("vec_id").collect()
    assert [r["component"] for r in got] == [1] * 9 and got[0]["explained"] == pytest.approx(1.0) and got[0]["identity_error"] < 1e-9


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(sample(40, 64, 5), SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening_query.op13_embedding_whitening(spark, str(tmp_path))
    assert dict(got.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double",
        "identity_error": "double", "deviation_exact": "decimal(38,0)",
    }
    assert got.where("deviation <> deviation_exact").count() == 0 and got.count() == 8 * (40 + 20 + 2)
