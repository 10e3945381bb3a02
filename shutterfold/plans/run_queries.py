"""Whole runs as queries: a cull of all events, a cache of all documents' reports, and the targets of all orders' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import runs, transfer
from ..operators.culling import Criteria, MetaFilter
from ..sources import collection
from .collection_queries import ITEMS, _t, _transfer_items

SETTINGS = runs.Settings(Criteria(focus=5.0, aesthetic=8.0), MetaFilter(iso_max=150), genre="landscape", sharp_min=0.05, burst_gap=120, burst_keep=2, hamming=0, dedup_keep=50)


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All events as one collection; errors couldn't be measured."""
    e = _t(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value").cast("float")
    items = e.select(F.col("event_id").alias("key"), F.col("event_id").alias("pos"), F.lit("unrated").alias("label"), F.lit(0).alias("stars"), F.lit(None).cast("string").alias("tag"))
    reports = e.where(kind != "error").select(
        F.col("event_id").alias("key"), value.alias("sharpness"), F.when(kind.isin("purchase", "signup"), value).alias("aesthetic"), (kind == "signup").alias("face"),
        F.when(kind == "click", value / 100).alias("sharp_ai"), F.when(kind != "click", F.floor("value")).alias("dhash"), F.lit(False).alias("from_cache"),
    )
    shots = e.select(F.col("event_id").alias("key"), F.when(F.col("value") >= 3, F.unix_timestamp("ts")).alias("shot_time"), F.col("value").cast("int").alias("iso"))
    return runs.cull(items, reports, SETTINGS, shots), reports


def cull_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = _run(spark, sf_dir)
    kinds = lambda c: F.array_join(F.transform(c, lambda f: f["kind"]), ",")
    return after.select("key", "place", "outcome", "label", "old_label", kinds("primary").alias("reasons"), kinds("secondary").alias("notes"), *(F.col(c).cast("long").alias(c) for c in ("burst_rank", "burst_size", "dedup_rank", "dedup_size")))


def cull_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.totals(*_run(spark, sf_dir))


_BEST = "ORDER BY CASE WHEN aes IS NOT NULL THEN 1 ELSE 0 END DESC, coalesce(aes, 0) DESC, sharp DESC, place"
RUN_SQL = f"""s AS (SELECT event_id AS key, event_type AS kind, CAST(value AS REAL) AS sharp, CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(value AS REAL) END AS aes,
    CAST(trunc(value) AS INTEGER) <= 150 AS included, CASE WHEN value >= 3 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS t, CASE WHEN event_type <> 'click' THEN floor(value) END AS h FROM events WHERE event_type <> 'error'
), o AS (SELECT *, row_number() OVER (ORDER BY t IS NULL, t, key) AS place, sharp < 5 AS f_focus, coalesce(aes < 8, false) AS f_aes, kind = 'signup' AS f_face,
    kind = 'click' AND CAST(CAST(sharp AS DOUBLE) / 100 AS REAL) < CAST(0.05 AS REAL) AS f_ai FROM s
), p AS (SELECT *, included AND NOT (f_focus OR f_aes OR f_face OR f_ai) AS dec, t - lag(t) OVER (PARTITION BY included ORDER BY place) AS gap FROM o
), b AS (SELECT *, sum(CASE WHEN gap IS NULL OR abs(gap) > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY included ORDER BY place) AS burst FROM p
), r AS (SELECT *, count(*) FILTER (dec) OVER (PARTITION BY included, burst) AS bn, row_number() OVER (PARTITION BY included, burst, dec {_BEST}) AS br FROM b
), q AS (SELECT *, CASE WHEN dec AND bn >= 2 THEN br END AS burst_rank, CASE WHEN dec AND bn >= 2 THEN bn END AS burst_size, dec AND NOT (bn >= 2 AND br > 2) AS dec2 FROM r
), c AS (SELECT *, count(*) FILTER (dec2) OVER (PARTITION BY included, h) AS dn, row_number() OVER (PARTITION BY included, h, dec2 {_BEST}) AS dr FROM q
), z AS (SELECT *, CASE WHEN included AND h IS NOT NULL AND dec2 AND dn >= 2 THEN dr END AS dedup_rank, CASE WHEN included AND h IS NOT NULL AND dec2 AND dn >= 2 THEN dn END AS dedup_size FROM c
), judged AS (SELECT *, CASE WHEN NOT included THEN 'excluded' WHEN dec2 AND NOT coalesce(dedup_rank > 50, false) THEN 'good' ELSE 'bad' END AS outcome FROM z)"""
CULL_RUN = f"""WITH {RUN_SQL}
SELECT e.event_id AS key, place, outcome, CASE outcome WHEN 'good' THEN 'pick' WHEN 'bad' THEN 'reject' ELSE 'unrated' END AS label, 'unrated' AS old_label,
  CASE WHEN outcome IS NULL THEN NULL WHEN outcome = 'bad' THEN concat_ws(',', CASE WHEN f_focus THEN 'focus' END, CASE WHEN f_aes THEN 'aesthetic' END, CASE WHEN burst_rank > 2 THEN 'burst' END, CASE WHEN dedup_rank > 50 THEN 'dedup' END,
    CASE WHEN f_face THEN 'face_in_landscape' END, CASE WHEN f_ai THEN 'sharp_ai' END) ELSE '' END AS reasons,
  CASE WHEN outcome IS NULL THEN NULL WHEN outcome = 'excluded' THEN '' ELSE concat_ws(',', CASE WHEN NOT f_focus THEN 'focus' END, CASE WHEN aes IS NOT NULL AND NOT f_aes THEN 'aesthetic' END, CASE WHEN burst_rank <= 2 THEN 'burst' END,
    CASE WHEN dedup_rank <= 50 THEN 'dedup' END, CASE WHEN kind = 'click' AND NOT f_ai THEN 'sharp_ai' END) END AS notes, burst_rank, burst_size, dedup_rank, dedup_size
FROM events e LEFT JOIN judged j ON j.key = e.event_id"""
CULL_TOTALS = f"""WITH {RUN_SQL}
SELECT count(*) FILTER (outcome = 'good') AS good, count(*) FILTER (outcome = 'bad') AS bad, count(*) FILTER (outcome = 'excluded') AS skipped, (SELECT count(*) FROM events WHERE event_type = 'error') AS unmeasured,
  CAST(0 AS BIGINT) AS cached, min(aes) AS low, max(aes) AS high FROM judged"""


def _cache_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as photos; the labelled ones have cached reports, those of low quality from an older file, some without a score."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    path = F.concat("source", F.lit("/"), "doc_id")
    sharpness = (F.col("n_chars") % 100 / 100).cast("float")
    wanted = d.select(F.col("doc_id").alias("key"), path.alias("path"), F.col("n_chars").alias("mtime"), F.lit(1).cast("long").alias("signature"))
    labels = _t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    cached = d.join(labels, "doc_id").select(path.alias("path"), (F.col("n_chars") + 1 - F.col("quality")).alias("mtime"), F.lit(1).cast("long").alias("signature"), sharpness.alias("sharpness"), F.when(F.col("toxic") == 0, F.lit(0.25).cast("float")).alias("aesthetic"))
    measure = lambda rows: rows.withColumn("sharpness", (F.col("mtime") % 100 / 100).cast("float")).where("mtime > 50")
    score = lambda rows: rows.withColumn("aesthetic", F.when(F.col("mtime") % 10 > 0, F.lit(0.75).cast("float")))
    return runs.measured(wanted, cached, measure, runs.Settings(Criteria(focus=0.4, aesthetic=0.5)), score)


def cached_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache_run(spark, sf_dir)[0].select("key", "from_cache", "sharpness", "aesthetic")


def cache_after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache_run(spark, sf_dir)[1].select("path", "mtime", "sharpness", "aesthetic")


CACHE_SQL = """d AS (SELECT d.doc_id AS key, d.source || '/' || d.doc_id AS path, n_chars AS mtime, CAST(n_chars % 100 / 100 AS REAL) AS sharpness, n_chars % 100 >= 40 AS passes, l.doc_id IS NOT NULL AS saved, quality, CASE WHEN toxic = 0 THEN CAST(0.25 AS REAL) END AS old_score
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), h AS (SELECT *, coalesce(saved AND quality = 1 AND (old_score IS NOT NULL OR NOT passes), false) AS hit, CASE WHEN passes AND mtime % 10 > 0 THEN CAST(0.75 AS REAL) END AS new_score FROM d)"""
CACHED_REPORTS = f"WITH {CACHE_SQL} SELECT key, hit AS from_cache, sharpness, CASE WHEN hit THEN old_score ELSE new_score END AS aesthetic FROM h WHERE hit OR mtime > 50"
CACHE_AFTER_RUN = f"""WITH {CACHE_SQL}, a AS (SELECT *, NOT hit AND mtime > 50 AND (new_score IS NOT NULL OR NOT passes) AS fresh FROM h)
SELECT path, CASE WHEN fresh THEN mtime ELSE mtime + 1 - quality END AS mtime, sharpness, CASE WHEN fresh THEN new_score ELSE old_score END AS aesthetic FROM a WHERE fresh OR saved ORDER BY 2 DESC, path LIMIT 50000"""


def transfer_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every order's files go when grades name them and stars split them, and which are there already."""
    items = _transfer_items(spark, sf_dir).withColumnRenamed("item_id", "item")
    rows = collection.planned(items, collection.Transfer("/shots", split="stars", template="{grade}{seq:04}-{order}-{tag}", by_grade=True))
    rows = rows.select("path", F.struct("folder", "name").alias("to"), transfer.in_place().alias("there"))
    back = rows.withColumns({"folder": F.lit("/shots/./"), "name": N.file_name(F.col("path"))})
    return back.select("path", "to.folder", "to.name", "there", transfer.in_place().alias("back"), transfer.in_place(by_folder=True).alias("same_folder"))


TRANSFER_TARGETS = f"""WITH {ITEMS}, files AS (SELECT DISTINCT l_orderkey, l_linenumber % 2 = 0 AS raw, '/shots/o' || l_orderkey || '_' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '.NEF' ELSE '.jpg' END AS path FROM lineitem
), n AS (SELECT item_id, tag, stars, row_number() OVER (ORDER BY item_id) AS seq, row_number() OVER (PARTITION BY stars ORDER BY item_id) AS g FROM items WHERE item_id IN (SELECT l_orderkey FROM files))
SELECT path, '/shots/' || CASE WHEN stars > 0 THEN stars || 'star' ELSE 'unrated' END AS folder, CASE WHEN stars = 0 THEN substr(path, 8) ELSE substr('EDCBA', stars, 1) || CASE WHEN g < 10000 THEN lpad(CAST(g AS VARCHAR), 4, '0') ELSE CAST(g AS VARCHAR) END
  || '-' || seq || '-' || coalesce(tag, 'untagged') || CASE WHEN raw THEN '.NEF' ELSE '.jpg' END END AS name, false AS there, true AS back, true AS same_folder FROM n JOIN files ON l_orderkey = item_id"""

QUERIES = {f.__name__: f for f in (cull_run, cull_totals, cached_reports, cache_after_run, transfer_targets)}
ORACLES = {"cull_run": CULL_RUN, "cull_totals": CULL_TOTALS, "cached_reports": CACHED_REPORTS, "cache_after_run": CACHE_AFTER_RUN, "transfer_targets": TRANSFER_TARGETS}
