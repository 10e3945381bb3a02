"""op9: every pair of a document and a benchmark item that leaks into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.overlaps(docs, items)


def drop_leaking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with benchmark passages go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), dw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d), iw AS (
  SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM i WHERE len(ws) >= 5
), m AS (SELECT doc_id, item_id, dw.p - iw.p AS diagonal, iw.p AS p FROM dw JOIN iw ON dw.w = iw.w), spans AS (
  SELECT c.doc_id, c.item_id, diagonal, greatest(0, -diagonal) AS lo, least(len(i.ws), len(d.ws) - diagonal) AS hi, least(13, len(i.ws)) AS width, CASE WHEN len(i.ws) >= 13 THEN 11 ELSE len(i.ws) END AS need
  FROM (SELECT doc_id, item_id, diagonal, count(*) AS c FROM m GROUP BY ALL) c JOIN d USING (doc_id) JOIN i USING (item_id) WHERE c >= CASE WHEN len(i.ws) >= 13 THEN 11 ELSE len(i.ws) END
), starts AS (SELECT *, unnest(range(lo, hi - width + 1)) AS s FROM spans), good AS (
  SELECT t.doc_id, t.item_id, t.diagonal, t.s, any_value(t.width) AS width FROM starts t JOIN m USING (doc_id, item_id, diagonal) WHERE m.p >= t.s AND m.p < t.s + t.width
  GROUP BY t.doc_id, t.item_id, t.diagonal, t.s HAVING count(*) >= any_value(t.need)
), whole AS (SELECT doc_id, item_id, diagonal, min(s) AS a, max(s) + any_value(width) AS b FROM good GROUP BY ALL), counted AS (
  SELECT doc_id, item_id, diagonal, a, b, count(*) AS matched FROM whole JOIN m USING (doc_id, item_id, diagonal) WHERE p >= a AND p < b GROUP BY ALL
)
SELECT doc_id, item_id, a + diagonal AS doc_start, b + diagonal AS doc_end, a AS item_start, b AS item_end, matched FROM counted
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, diagonal) = 1
"""

QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
ORACLES = {"op9_benchmark_decontamination": ORACLE}
