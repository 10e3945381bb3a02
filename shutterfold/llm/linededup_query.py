"""op2: every document without the passages of 50 words or more that stand earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linededup.dedup(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated runs go from the texts; documents of which no word is left go."""
    cleaned = linededup.dedup(docs, removed="__removed")
    left = cleaned.where((F.col("__removed") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


ORACLE = """
WITH lines AS (
  SELECT doc_id, line, pos, CASE WHEN trim(line, ' ') = '' THEN 0 ELSE length(trim(line, ' ')) - length(replace(trim(line, ' '), ' ', '')) + 1 END AS nw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
), worded AS (
  SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS e, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) - nw AS s FROM lines WHERE nw > 0
), wins AS (
  SELECT doc_id, 'f' AS side, min(pos) OVER f AS a, max(pos) OVER f AS b, max(e) OVER f - min(s) OVER f AS held, list(line) OVER f AS content
  FROM worded WINDOW f AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, 'b', min(pos) OVER b, max(pos) OVER b, max(e) OVER b - min(s) OVER b, list(line) OVER b
  FROM worded WINDOW b AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), ranked AS (
  SELECT doc_id, a, b, row_number() OVER (PARTITION BY side, content ORDER BY doc_id, a) AS nth FROM wins WHERE held >= 50
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM ranked WHERE nth > 1
)
SELECT d.doc_id,
  CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
  coalesce(g.n, 0) AS lines_removed
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id
LEFT JOIN (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l ANTI JOIN gone x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id) k ON d.doc_id = k.doc_id
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {"op2_line_dedup": ORACLE}
