"""op8: a verdict for every page under the five rules of the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import urlfilter

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op8_url_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    judged = urlfilter.judge(pages.select("page_id", "url"), rules, urlfilter.page_edges(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


# The SQL leaves "." and ".." segments of relative targets as they are; the tests compare those with the standard library.
ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
    regexp_extract(url, '^([^/?#]*?)://', 1) AS scheme, regexp_extract(url, '^[^/?#]*?://([^/?#]*)', 1) AS site, regexp_extract(url, '^[^/?#]*?://[^/?#]*([^?#]*)', 1) AS own, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query,
    regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>') AS links, regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>') AS metas
  FROM pages
), goes AS (
  SELECT url, scheme, site, own, query, regexp_extract(unnest(links), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM p
  UNION ALL
  SELECT url, scheme, site, own, query, regexp_extract(unnest(metas), '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) FROM p
), links AS (
  SELECT url AS src, CASE WHEN regexp_matches(t, '^[^/?#]*://') THEN t
    WHEN t = '' OR scheme = '' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '//') THEN scheme || ':' || t
    WHEN starts_with(t, '/') THEN scheme || '://' || site || t
    WHEN starts_with(t, '?') THEN scheme || '://' || site || own || t
    WHEN starts_with(t, '#') THEN scheme || '://' || site || own || query || t
    ELSE scheme || '://' || site || CASE WHEN instr(own, '/') > 0 THEN regexp_extract(own, '^.*/') ELSE '/' END || t END AS dst FROM goes WHERE url IS NOT NULL
), named AS (
  SELECT url FROM p WHERE url IS NOT NULL UNION SELECT dst FROM links WHERE dst IS NOT NULL
), parts AS (
  SELECT url, translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path
  FROM named WHERE instr(url, '://') > 0
), two AS (SELECT src AS a, dst AS b FROM links WHERE dst IS NOT NULL UNION SELECT dst, src FROM links WHERE dst IS NOT NULL), reach AS (
  SELECT a AS node, a AS seen FROM two UNION SELECT r.node, t.b FROM reach r JOIN two t ON r.seen = t.a
), rules(rhost, rpath, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), decided AS (
  SELECT url, rhost || rpath AS rule, action FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action) = 1
), spread AS (
  SELECT node, CASE WHEN bool_or(action = 'block') AND NOT bool_or(action = 'allow') THEN 'block' ELSE 'allow' END AS verdict FROM reach JOIN decided ON seen = url GROUP BY node
)
SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, d.rule, coalesce(d.action, s.verdict, 'allow') AS verdict
FROM p LEFT JOIN decided d ON p.url = d.url LEFT JOIN spread s ON p.url = s.node
"""

QUERIES = {"op8_url_redirect_equivalence": op8_url_redirect_equivalence}
ORACLES = {"op8_url_redirect_equivalence": ORACLE}
