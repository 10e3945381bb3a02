"""Embeddings as small grey images: measures and model scores of pixels, with SQL that computes them over rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..operators import cache, scoring

WIDTH = 8


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, image``: components as brightness 0..255, eight a line; what fills no line is left out, and components that are no finite numbers are dark."""
    x = F.col("embedding")
    scaled = lambda v: F.greatest(F.least(F.floor((v.cast("double") + 0.5) * 255), F.lit(255)), F.lit(0))
    brightness = F.transform(x, lambda v: F.when(F.abs(v) < float("inf"), scaled(v)).otherwise(0))
    data = F.unhex(F.array_join(F.transform(brightness, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    lines = F.floor(F.size(x) / WIDTH).cast("int")
    image = F.struct(lines.alias("height"), F.lit(WIDTH).alias("width"), F.lit(1).alias("nChannels"), F.substring(data, F.lit(1), lines * WIDTH).alias("data"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", image.alias("image"))


IMAGES = f"""lists AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN CAST(greatest(least(floor((x::DOUBLE + 0.5) * 255), 255), 0) AS BIGINT) ELSE 0 END) AS l, len(embedding) // {WIDTH} AS h FROM embeddings),
px AS (SELECT vec_id, h, CAST((i - 1) // {WIDTH} AS BIGINT) AS y, CAST((i - 1) % {WIDTH} AS BIGINT) AS x, l[i] AS v FROM (SELECT *, unnest(range(1, h * {WIDTH} + 1)) AS i FROM lists))"""


def image_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure, focus, tilt, difference hash and fullest colour bin of each image."""
    r = pixels.score_images(_images(spark, sf_dir), signals=pixels.SIGNALS)
    names = ("exposure", "mean", "sharpness", "in_focus", "tilt", "tilt_confidence", "dhash")
    return r.where("report is not null").select("vec_id", *(F.col(f"report.{n}") for n in names), cache.histogram_top(F.col("report.histogram")).cast("long").alias("top"))


IMAGE_REPORTS = f"""WITH {IMAGES},
bins AS (SELECT vec_id, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY vec_id ORDER BY v) AS cum, sum(count(*)) OVER (PARTITION BY vec_id) AS total FROM px GROUP BY vec_id, v),
light AS (SELECT vec_id, sum(n * v) / sum(n) / 255 AS mean, coalesce(sum(n) FILTER (v >= 250), 0) / sum(n) AS high, coalesce(sum(n) FILTER (v <= 5), 0) / sum(n) AS low FROM bins GROUP BY vec_id),
tops AS (SELECT vec_id, max(n) AS top FROM (SELECT vec_id, v >> 2, count(*) AS n FROM px GROUP BY ALL) GROUP BY vec_id),
around AS (SELECT a.vec_id, a.y, a.x, max(a.v) AS c, max(a.h) AS h, map_from_entries(list((((b.y - a.y) * 3 + b.x - a.x), b.v))) AS m
  FROM px a JOIN px b ON a.vec_id = b.vec_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 WHERE a.y BETWEEN 1 AND a.h - 2 AND a.x BETWEEN 1 AND {WIDTH} - 2 GROUP BY a.vec_id, a.y, a.x),
focus AS (SELECT vec_id, sqrt(avg((4 * c - m[-1] - m[1] - m[-3] - m[3]) ** 2)) AS a FROM around GROUP BY vec_id),
sobel AS (SELECT vec_id, (m[-2] + 2 * m[1] + m[4]) - (m[-4] + 2 * m[-1] + m[2]) AS gx, (m[2] + 2 * m[3] + m[4]) - (m[-4] + 2 * m[-3] + m[-2]) AS gy FROM around WHERE h >= 8),
strong AS (SELECT vec_id, sqrt(gx * gx + gy * gy) AS mass, degrees(atan2(gy, gx)) + 45 AS a FROM sobel WHERE gx * gx + gy * gy >= 3600),
turned AS (SELECT vec_id, mass, a - 90 * floor(a / 90) - 45 AS off FROM strong),
angles AS (SELECT vec_id, CAST(round((off + 12) * 5) AS BIGINT) AS bin, sum(mass) AS mass FROM turned WHERE abs(off) <= 12 GROUP BY ALL),
smooth AS (SELECT vec_id, bin + d AS bin, sum(mass * CASE WHEN d = 0 THEN 0.5::DOUBLE ELSE 0.25 END) AS s FROM angles, (VALUES (-1), (0), (1)) AS t(d) WHERE bin + d BETWEEN 0 AND 120 GROUP BY ALL),
peak AS (SELECT vec_id, bin AS top FROM smooth QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, bin) = 1),
level AS (SELECT vec_id, sum(mass * (bin / 5.0::DOUBLE - 12)) / sum(mass) AS tilt, sum(mass) AS inside FROM angles JOIN peak USING (vec_id) WHERE bin BETWEEN top - 3 AND top + 3 GROUP BY vec_id),
sure AS (SELECT vec_id, tilt, inside / (SELECT sum(mass) FROM strong s WHERE s.vec_id = level.vec_id) AS confidence FROM level),
signs AS (SELECT a.vec_id, CAST(sum(CASE WHEN a.v < b.v THEN CASE WHEN i * 8 + j = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << CAST(i * 8 + j AS INTEGER) END ELSE 0 END) AS BIGINT) AS dhash
  FROM (SELECT i, j FROM range(8) AS r(i), range(8) AS s(j)) JOIN px a ON a.y = i * a.h // 8 AND a.x = j * {WIDTH} // 9 JOIN px b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = (j + 1) * {WIDTH} // 9 GROUP BY a.vec_id)
SELECT vec_id, CAST(greatest(least((1 - least(6 * high + 4 * low, 1)) * (1 - CASE WHEN mean < 0.25 THEN (0.25 - mean) / 0.25 WHEN mean > 0.75 THEN (mean - 0.75) / 0.25 ELSE 0 END), 1), 0) AS REAL) AS exposure,
  CAST(mean AS REAL) AS mean, CAST(coalesce(a / (a + 8), 0) AS REAL) AS sharpness, coalesce(a / (a + 8), 0) >= 0.45 AS in_focus, CAST(coalesce(tilt, 0) AS REAL) AS tilt, CAST(coalesce(confidence, 0) AS REAL) AS tilt_confidence, dhash, top
FROM light JOIN tops USING (vec_id) JOIN signs USING (vec_id) LEFT JOIN focus USING (vec_id) LEFT JOIN sure USING (vec_id)"""


def _brightness_model() -> Callable[[np.ndarray], np.ndarray]:
    """A model with weights of its own in place of a file: how much brighter each image is to the right and below than to the left and above."""

    def run(batch: np.ndarray) -> np.ndarray:
        y, x = np.indices(batch.shape[1:3])
        return (batch * (x + y)).sum(axis=(1, 2)) / (batch.sum(axis=(1, 2)) + 1)

    return run


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's scores of whole batches of images, as ranks are made of them; images without a line have none."""
    return scoring.score(_images(spark, sf_dir), _brightness_model, lambda image: image[..., 0].astype(np.float64), float, "score", "float").where("image.height > 0").select("vec_id", "score")


MODEL_SCORES = f"WITH {IMAGES} SELECT vec_id, CAST(sum(v * (x + y)) / (sum(v) + 1) AS REAL) AS score FROM px GROUP BY vec_id"

QUERIES = {f.__name__: f for f in (image_reports, model_scores)}
ORACLES = {"image_reports": IMAGE_REPORTS, "model_scores": MODEL_SCORES}
