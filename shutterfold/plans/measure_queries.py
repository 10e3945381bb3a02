"""Parsers, geometry and histograms over columns of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exif, geo, pixels


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exif_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as capture metadata and parsed back."""
    o = _t(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = o.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss").alias("d"), F.concat(F.lit("ISO "), (key % 64) * 100).alias("i"),
        F.concat(F.lit("f/"), (key % 20).cast("string"), F.lit(".5")).alias("a"), F.concat((key % 300).cast("string"), F.lit(".0 mm")).alias("f"), F.concat(F.lit("1/"), key % 500, F.lit(" s")).alias("s"),
    )
    shown = exif.display_size(F.lit(6000), F.lit(4000), (key % 9).cast("int"))
    return text.select(
        "o_orderkey", exif.epoch_seconds(F.col("d")).alias("secs"), exif.iso(F.col("i")).alias("iso"), exif.aperture(F.col("a")).alias("aperture"),
        exif.focal(F.col("f")).alias("focal"), exif.shutter(F.col("s")).alias("shutter"), shown["w"].alias("w"), shown["h"].alias("h"),
    )


EXIF_PARSE = """SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS secs, CASE WHEN o_orderkey % 64 > 0 THEN (o_orderkey % 64) * 100 END AS iso, CAST((o_orderkey % 20) || '.5' AS REAL) AS aperture,
  CAST(o_orderkey % 300 AS REAL) AS focal, CASE WHEN o_orderkey % 500 > 0 THEN CAST(1 AS REAL) / CAST(o_orderkey % 500 AS REAL) END AS shutter,
  CASE WHEN o_orderkey % 9 BETWEEN 5 AND 8 THEN 4000 ELSE 6000 END AS w, CASE WHEN o_orderkey % 9 BETWEEN 5 AND 8 THEN 6000 ELSE 4000 END AS h FROM orders"""


def gps_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer numbers as degrees and minutes, their coordinates and map tile."""
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    lat = exif.gps_decimal((k % 80).cast("double"), (k % 60).cast("double"), F.lit(None).cast("double"), F.when(k % 2 == 0, "N").otherwise("S"), 90.0)
    lon = exif.gps_decimal((k % 200).cast("double"), F.lit(0.0), (k % 50).cast("double"), F.when(k % 3 == 0, "W").otherwise("E"), 180.0)
    at = c.select("c_custkey", lat.alias("lat"), lon.alias("lon")).where(exif.gps(F.col("lat"), F.col("lon"), F.lit(None).cast("double"), F.lit(None).cast("int")).isNotNull())
    t = geo.tile(F.col("lat"), F.col("lon"), 10)
    return at.select("c_custkey", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.floor(t["x"]).alias("x"), F.floor(t["y"]).alias("y"), F.size(geo.tile_window(t["x"], t["y"], 10, 800, 600)).alias("tiles"))


GPS_TILE = """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (c_custkey % 80 + (c_custkey % 60) / 60.0::DOUBLE) AS lat, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 1 END * (c_custkey % 200 + (c_custkey % 50) / 3600.0::DOUBLE) AS lon FROM customer),
t AS (SELECT *, (lon + 180.0) / 360.0 * 1024 AS x, (1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 1024 AS y FROM a WHERE abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0))
SELECT c_custkey, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(floor(x) AS BIGINT) AS x, CAST(floor(y) AS BIGINT) AS y,
  CAST((floor(x + 800 / 2.0 / 256) - floor(x - 800 / 2.0 / 256) + 1) * (least(floor(y + 600 / 2.0 / 256), 1023) - greatest(floor(y - 600 / 2.0 / 256), 0) + 1) AS INTEGER) AS tiles FROM t"""


def af_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus boxes turned to display coordinates and the centre of the pair."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    a = geo.oriented_box((k % 100) / 100, (k % 37) / 37, F.lit(0.2), F.lit(0.4), (k % 8 + 1).cast("int"))
    point = lambda box, focus: F.struct(box["cx"].alias("cx"), box["cy"].alias("cy"), focus.alias("in_focus"), (k % 3 == 0).alias("selected"))
    b = geo.oriented_box(F.lit(0.25), F.lit(0.75), F.lit(0.1), F.lit(0.1), F.lit(1))
    centre = geo.focus_centre(F.array(point(a, k % 2 == 0), point(b, k % 5 == 0)))
    return p.select("p_partkey", F.round(a["cx"], 9).alias("cx"), F.round(a["cy"], 9).alias("cy"), a["w"].alias("w"), a["h"].alias("h"), F.round(centre["cx"], 9).alias("mx"), F.round(centre["cy"], 9).alias("my"))


AF_COORDS = """WITH k AS (SELECT p_partkey, (p_partkey % 100) / 100.0::DOUBLE AS x, (p_partkey % 37) / 37.0::DOUBLE AS y, p_partkey % 8 + 1 AS o, p_partkey % 2 = 0 AS fa, p_partkey % 5 = 0 AS fb FROM part),
b AS (SELECT *, CASE o WHEN 2 THEN 1 - x WHEN 3 THEN 1 - x WHEN 5 THEN y WHEN 6 THEN 1 - y WHEN 7 THEN 1 - y WHEN 8 THEN y ELSE x END AS cx, CASE o WHEN 3 THEN 1 - y WHEN 4 THEN 1 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 1 - x WHEN 8 THEN 1 - x ELSE y END AS cy FROM k)
SELECT p_partkey, round(cx, 9) AS cx, round(cy, 9) AS cy, CASE WHEN o >= 5 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS w, CASE WHEN o >= 5 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END AS h,
  round(CASE WHEN fa AND NOT fb THEN cx WHEN fb AND NOT fa THEN 0.25 ELSE (cx + 0.25) / 2 END, 9) AS mx, round(CASE WHEN fa AND NOT fb THEN cy WHEN fb AND NOT fa THEN 0.75 ELSE (cy + 0.75) / 2 END, 9) AS my FROM b"""


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred-square guides of a frame and the middle of the widest gap between own lines."""
    p = _t(spark, sf_dir, "part")
    square = geo.guide_lines("square", F.col("p_size").cast("double") + 10, F.lit(30.0))
    own = geo.guide_lines("custom", custom=F.array((F.col("p_size") / 50).cast("double"), F.lit(0.25).cast("double"), (F.col("p_partkey") % 10 / 5).cast("double")))
    return p.select("p_partkey", F.size(square).alias("n_square"), F.round(geo.largest_gap_middle(own), 9).alias("middle"))


GUIDES = """WITH s AS (SELECT p_partkey, p_size, list_sort([0.0::DOUBLE, 1.0, greatest(least(p_size / 50.0::DOUBLE, 1), 0), 0.25, least((p_partkey % 10) / 5.0::DOUBLE, 1)]) AS l FROM part),
g AS (SELECT p_partkey, p_size, list_transform(range(1, 5), lambda i: {'w': l[i + 1] - l[i], 'm': (l[i] + l[i + 1]) / 2}) AS gaps FROM s)
SELECT p_partkey, CAST(CASE WHEN p_size + 10 > 30 THEN 2 ELSE 0 END AS INTEGER) AS n_square,
  round(list_reduce(list_prepend({'w': -1.0::DOUBLE, 'm': 0.5::DOUBLE}, gaps), lambda a, b: CASE WHEN b.w > a.w + 0.0001 THEN b ELSE a END).m, 9) AS middle FROM g"""


def lut_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 3-D table whose cells are r + 2g + 4b reproduces that plane between its cells."""
    size = 5
    table = F.array(*(F.lit(float(x + 2 * y + 4 * z)) for z in range(size) for y in range(size) for x in range(size)))
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select("p_partkey", F.round(geo.lut_sample(table, size, (k % 101) / 100, (k % 53) / 53, (k % 29) / 29), 6).alias("value"))


LUT_SAMPLE = "SELECT p_partkey, round(4 * (least((p_partkey % 101) / 100.0::DOUBLE, 1) + 2 * (p_partkey % 53) / 53.0::DOUBLE + 4 * (p_partkey % 29) / 29.0::DOUBLE), 6) AS value FROM part"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding components as brightness values 0..255."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.select("vec_id", "pos", F.greatest(F.least(F.floor((F.col("x").cast("double") + 0.5) * 255), F.lit(255)), F.lit(0)).cast("int").alias("v"))


PIXELS = "px AS (SELECT vec_id, pos, CAST(greatest(least(floor((x::DOUBLE + 0.5) * 255), 255), 0) AS INTEGER) AS v FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"


def exposure_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = _pixels(spark, sf_dir).groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    e = pixels.exposure(hist, "vec_id")
    return e.select("vec_id", *(F.round(c, 9).alias(c) for c in ("mean", "high", "low", "range", "score")))


EXPOSURE_HIST = f"""WITH {PIXELS}, h AS (SELECT vec_id, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY vec_id ORDER BY v) AS cum, sum(count(*)) OVER (PARTITION BY vec_id) AS total FROM px GROUP BY vec_id, v),
s AS (SELECT vec_id, sum(n * v) / sum(n) / 255 AS mean, coalesce(sum(n) FILTER (v >= 250), 0) / sum(n) AS high, coalesce(sum(n) FILTER (v <= 5), 0) / sum(n) AS low,
  (CASE WHEN floor(max(total) * 0.995) = 0 THEN 0 ELSE min(v) FILTER (cum >= floor(total * 0.995)) END - CASE WHEN floor(max(total) * 0.005) = 0 THEN 0 ELSE min(v) FILTER (cum >= floor(total * 0.005)) END) / 255 AS range FROM h GROUP BY vec_id)
SELECT vec_id, round(mean, 9) AS mean, round(high, 9) AS high, round(low, 9) AS low, round(range, 9) AS range,
  round(greatest(least((1 - least(6 * high + 4 * low, 1)) * (1 - CASE WHEN mean < 0.25 THEN (0.25 - mean) / 0.25 WHEN mean > 0.75 THEN (mean - 0.75) / 0.25 ELSE 0 END), 1), 0), 9) AS score FROM s"""


def percentile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = _t(spark, sf_dir, "lineitem").groupBy("l_shipdate", F.col("l_quantity").cast("int").alias("v")).agg(F.count("*").alias("n"))
    return pixels.percentile_bins(hist, "l_shipdate", "v", "n", {"lo": 0.1, "hi": 0.9})


PERCENTILE_BINS = """WITH h AS (SELECT l_shipdate, CAST(l_quantity AS INTEGER) AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_shipdate ORDER BY CAST(l_quantity AS INTEGER)) AS cum, sum(count(*)) OVER (PARTITION BY l_shipdate) AS total FROM lineitem GROUP BY 1, 2)
SELECT l_shipdate, CAST(CASE WHEN floor(max(total) * 0.1) = 0 THEN 0 ELSE min(v) FILTER (cum >= floor(total * 0.1)) END AS INTEGER) AS lo, CAST(CASE WHEN floor(max(total) * 0.9) = 0 THEN 0 ELSE min(v) FILTER (cum >= floor(total * 0.9)) END AS INTEGER) AS hi FROM h GROUP BY l_shipdate"""


def rgb_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bin histograms of three channels: position modulo 3 is the channel."""
    return _pixels(spark, sf_dir).groupBy((F.col("pos") % 3).alias("channel"), F.shiftright("v", 2).alias("bin")).agg(F.count("*").alias("n"))


RGB_HIST = f"WITH {PIXELS} SELECT CAST(pos % 3 AS INTEGER) AS channel, v >> 2 AS bin, count(*) AS n FROM px GROUP BY ALL"

QUERIES = {f.__name__: f for f in (exif_parse, gps_tile, af_coords, guides, lut_sample, exposure_hist, percentile_bins, rgb_hist)}
ORACLES = {"exif_parse": EXIF_PARSE, "gps_tile": GPS_TILE, "af_coords": AF_COORDS, "guides": GUIDES, "lut_sample": LUT_SAMPLE, "exposure_hist": EXPOSURE_HIST, "percentile_bins": PERCENTILE_BINS, "rgb_hist": RGB_HIST}
