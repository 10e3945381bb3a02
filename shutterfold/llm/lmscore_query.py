"""op1: how much closer every document is to dialogue (all turns of ``conversations``) than to the corpus itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lmscore

DECIMALS = 6  # sums of logarithms differ in their last bits by the order of adding


def op1_lm_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text")
    found = lmscore.difference(docs, turns)
    return found.select("doc_id", "lm.n_words", *(F.round(f"lm.{c}", DECIMALS).alias(c) for c in ("target_loss", "background_loss", "score")))


ORACLE = r"""
WITH texts AS (
  SELECT 0 AS side, doc_id AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
  UNION ALL
  SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM conversations
), words AS (
  SELECT side, d, unnest(ws) AS w, unnest(list_concat([NULL], ws[1:len(ws) - 1])) AS h FROM texts WHERE len(ws) > 0
), uni AS (
  SELECT w, count(*) FILTER (side = 1) AS t, count(*) FILTER (side = 0) AS b FROM words GROUP BY w
), bi AS (
  SELECT h, w, count(*) FILTER (side = 1) AS t, count(*) FILTER (side = 0) AS b FROM words WHERE h IS NOT NULL GROUP BY h, w
), n AS (
  SELECT sum(t) + (SELECT count(*) FROM texts WHERE side = 1 AND len(ws) > 0) + count(*) + 2 AS t, sum(b) + (SELECT count(*) FROM texts WHERE side = 0 AND len(ws) > 0) + count(*) + 2 AS b FROM uni
), p AS (
  SELECT x.d, x.h, (u.t + 1) / n.t::DOUBLE AS ut, (u.b + 1) / n.b::DOUBLE AS ub, g.t AS gt, g.b AS gb, v.t AS vt, v.b AS vb
  FROM words x JOIN uni u ON x.w = u.w LEFT JOIN bi g ON x.h = g.h AND x.w = g.w LEFT JOIN uni v ON x.h = v.w CROSS JOIN n WHERE x.side = 0
), means AS (
  SELECT d, count(*) AS n, avg(-ln(CASE WHEN h IS NULL THEN ut ELSE (gt + 50 * ut) / (vt + 50) END)) AS t, avg(-ln(CASE WHEN h IS NULL THEN ub ELSE (gb + 50 * ub) / (vb + 50) END)) AS b FROM p GROUP BY d
)
SELECT doc_id, coalesce(m.n, 0) AS n_words, round(coalesce(m.t, 0), 6) AS target_loss, round(coalesce(m.b, 0), 6) AS background_loss, round(coalesce(m.t - m.b, 0), 6) AS score
FROM documents LEFT JOIN means m ON doc_id = m.d
"""

QUERIES = {"op1_lm_cross_entropy_difference": op1_lm_cross_entropy_difference}
ORACLES = {"op1_lm_cross_entropy_difference": ORACLE}
