"""op4: near-duplicate groups of all documents by 4-word shingles at 85 percent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ngramjoin


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngramjoin.components(docs, n=4, percent=85)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of every near-duplicate group (five words, 80 percent) stays."""
    return ngramjoin.one_of_each(docs, n=5, percent=80)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), both_hold AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM both_hold JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), two AS (SELECT x, y FROM links UNION SELECT y, x FROM links), reach AS (
  SELECT x AS node, x AS seen FROM two UNION SELECT r.node, t.y FROM reach r JOIN two t ON r.seen = t.x
), least AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id
"""

QUERIES = {"op4_ngram_jaccard_join": op4_ngram_jaccard_join}
ORACLES = {"op4_ngram_jaccard_join": ORACLE}
