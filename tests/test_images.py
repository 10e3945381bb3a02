"""Measures and model scores of rows as images, against their SQL and against the kernels on each image."""

import math

import duckdb
import numpy as np
import pytest

from shutterfold.functions import pixels
from shutterfold.plans import image_queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = np.random.default_rng(3)
    rows = [(n, [float(np.float32(v)) for v in r.uniform(-0.6, 0.6, size)]) for n, size in enumerate([64] * 30 + [8, 16, 24, 67, 120])]
    rows += [(100, None), (101, []), (102, [0.1] * 7), (103, [None] + [0.2] * 63), (104, [math.nan, math.inf, -math.inf] + [0.4] * 61), (105, [0.25] * 64), (106, [0.5] * 32 + [-0.5] * 32)]
    place = tmp_path_factory.mktemp("images")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(place / "embeddings.parquet"))
    return str(place), dict(rows)


@pytest.mark.parametrize("name", sorted(image_queries.QUERIES))
def test_queries_and_their_sql_agree(spark, tables, name):
    got = image_queries.QUERIES[name](spark, tables[0])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tables[0]}/embeddings.parquet/*.parquet')")
    found = con.execute(image_queries.ORACLES[name])
    assert [d[0] for d in found.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())
    assert got.count() == 39  # all but those without a line of pixels


def test_reports_are_those_of_the_kernels(spark, tables):
    for row in image_queries.image_reports(spark, tables[0]).collect():
        x = tables[1][row.vec_id]
        x = [v if v is not None and math.isfinite(v) else -1.0 for v in x[: len(x) // 8 * 8]]
        grey = np.clip(np.floor((np.array(x) + 0.5) * 255), 0, 255).astype(np.uint8).reshape(-1, 8)
        want = pixels.report(np.repeat(grey[..., None], 3, axis=2))
        assert row.dhash == want["dhash"] and row.in_focus == want["in_focus"] and row.top == max(want["histogram"])
        assert all(math.isclose(row[k], want[k], rel_tol=1e-6, abs_tol=1e-6) for k in ("exposure", "mean", "sharpness", "tilt", "tilt_confidence"))
