"""Culling over ``events``: users are folders, events are shots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import culling as C

GAP = 7200
ISO_CAP = 150
META = C.MetaFilter(iso_max=ISO_CAP)


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as shots: value is rank, sharpness and ISO; some types carry an aesthetic score."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.col("value").cast("float")
    return e.select(
        "user_id", F.col("event_id").alias("idx"), "event_type", F.unix_timestamp("ts").alias("shot_time"),
        (F.col("event_type") != "error").alias("good"), v.alias("rank"),
        F.when(F.col("event_type").isin("purchase", "signup"), v).alias("aesthetic"), F.when(F.col("event_type") != "view", v).alias("sharp"),
        F.col("value").cast("int").alias("iso"),
    )


SHOTS_SQL = """shots AS (
  SELECT user_id, event_id AS idx, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS shot_time, event_type <> 'error' AS good, CAST(value AS REAL) AS rank,
    CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(value AS REAL) END AS aesthetic, CASE WHEN event_type <> 'view' THEN CAST(value AS REAL) END AS sharp,
    CAST(trunc(value) AS INTEGER) AS iso
  FROM events)"""


def burst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.burst_ids(shots(spark, sf_dir), ["user_id"], [F.col("shot_time"), F.col("idx")], GAP)
    return found.select("user_id", "idx", "burst")


BURST_GROUPS = f"""WITH {SHOTS_SQL}, o AS (
  SELECT *, shot_time - lag(shot_time) OVER (PARTITION BY user_id ORDER BY shot_time, idx) AS d FROM shots)
SELECT user_id, idx, CAST(sum(CASE WHEN d IS NULL OR abs(d) > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY shot_time, idx) AS BIGINT) AS burst FROM o"""


def burst_best_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = shots(spark, sf_dir).withColumns({"aesthetic": F.lit(None).cast("float"), "sharp": F.lit(None).cast("float")})
    grouped = C.burst_ids(plain, ["user_id"], [F.col("shot_time"), F.col("idx")], GAP)
    best = C.best_n(grouped, ["user_id", "burst"], 2, F.lit(True), "burst")
    return best.where(~F.col("burst_out")).select("user_id", "idx", "burst", F.coalesce("burst_rank", F.lit(1)).cast("long").alias("place"))


BURST_BEST_N = f"""WITH g AS ({BURST_GROUPS})
SELECT g.user_id, g.idx, g.burst, row_number() OVER (PARTITION BY g.user_id, g.burst ORDER BY CAST(e.value AS REAL) DESC, g.idx) AS place
FROM g JOIN events e ON e.event_id = g.idx QUALIFY place <= 2"""


def cull_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks, verdict, metadata exclusion, bursts and best-2, each with its reason."""
    items = shots(spark, sf_dir).withColumns({"sharpness": F.coalesce("sharp", F.lit(0.0).cast("float"))})
    judged = C.verdicts(items.withColumnRenamed("good", "usable"), C.Criteria(focus=5.0, aesthetic=8.0))
    judged = judged.withColumn("good", F.col("good") & F.col("usable"))
    out = C.explain(C.decide(judged, ["user_id"], META, GAP, 2), burst_keep=2)
    facts = lambda c: F.array_join(F.transform(c, lambda x: x["kind"]), ",")
    return out.select("user_id", "idx", "outcome", "burst", F.col("burst_rank").cast("long").alias("burst_rank"), F.col("burst_size").cast("long").alias("burst_size"), facts("primary").alias("primary_facts"), facts("secondary").alias("secondary_facts"))


CULL_EXPLAIN = f"""WITH {SHOTS_SQL}, j AS (
  SELECT *, coalesce(sharp, 0) < 5 AS f_focus, aesthetic IS NOT NULL AS has_a, coalesce(aesthetic < 8, false) AS f_aes, coalesce(iso <= {ISO_CAP}, true) AS included FROM shots
), v AS (SELECT *, good AND NOT f_focus AND NOT f_aes AS g0 FROM j), d AS (
  SELECT *, g0 AND included AS dec, shot_time - lag(shot_time) OVER (PARTITION BY user_id, included ORDER BY shot_time, idx) AS gap FROM v
), b AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR abs(gap) > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, included ORDER BY shot_time, idx) AS BIGINT) AS burst FROM d
), r AS (SELECT *, count(*) FILTER (dec) OVER w AS n, bool_or(dec AND (aesthetic IS NOT NULL OR sharp IS NOT NULL)) OVER w AS rich FROM b WINDOW w AS (PARTITION BY user_id, included, burst)
), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, included, burst, dec ORDER BY CASE WHEN rich AND aesthetic IS NOT NULL THEN 1 ELSE 0 END DESC,
    CASE WHEN rich THEN coalesce(aesthetic, 0) ELSE 0 END DESC, CASE WHEN rich THEN coalesce(sharp, 0) ELSE rank END DESC, idx) AS rn FROM r
), z AS (SELECT *, CASE WHEN dec AND n >= 2 THEN rn END AS burst_rank, CASE WHEN dec AND n >= 2 THEN n END AS burst_size FROM k
), o AS (SELECT *, coalesce(burst_rank > 2, false) AS lost, CASE WHEN NOT included THEN 'excluded' WHEN dec AND NOT coalesce(burst_rank > 2, false) THEN 'good' ELSE 'bad' END AS outcome,
    concat_ws(',', CASE WHEN f_focus THEN 'focus' END, CASE WHEN f_aes THEN 'aesthetic' END, CASE WHEN coalesce(burst_rank > 2, false) THEN 'burst' END) AS failed,
    concat_ws(',', CASE WHEN NOT f_focus THEN 'focus' END, CASE WHEN has_a AND NOT f_aes THEN 'aesthetic' END, CASE WHEN burst_rank <= 2 THEN 'burst' END) AS other FROM z)
SELECT user_id, idx, outcome, burst, burst_rank, burst_size, CASE WHEN outcome = 'bad' THEN failed ELSE '' END AS primary_facts,
  CASE outcome WHEN 'good' THEN concat_ws(',', nullif(failed, ''), nullif(other, '')) WHEN 'bad' THEN other ELSE '' END AS secondary_facts FROM o"""


def _scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    scores = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    joined = d.join(scores, "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("idx"), (F.col("n_chars") % 100 / 100).cast("float").alias("sharpness"), (F.col("n_chars") % 37 / 37).cast("float").alias("exposure"),
        (F.col("doc_id") % 21 - 10).cast("float").alias("tilt"), (F.col("doc_id") % 7 / 7).cast("float").alias("tilt_confidence"),
        (F.col("quality") * (F.col("n_chars") % 1000) / 1000).cast("float").alias("aesthetic"), (F.col("toxic") == 1).alias("toxic"),
    )


SCORED_SQL = """s AS (SELECT d.doc_id AS idx, CAST((n_chars % 100) / 100 AS REAL) AS sharpness, CAST((n_chars % 37) / 37 AS REAL) AS exposure, CAST(d.doc_id % 21 - 10 AS REAL) AS tilt,
  CAST((d.doc_id % 7) / 7 AS REAL) AS tilt_confidence, CAST(quality * (n_chars % 1000) / 1000 AS REAL) AS aesthetic, toxic = 1 AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
LIMITS = C.Criteria(focus=0.2, exposure=0.1, tilt=6.0, aesthetic=0.3)


def threshold_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = C.verdicts(_scored_documents(spark, sf_dir), LIMITS)
    return judged.select(
        "idx", "cv_good", (F.col("good") & ~C.hard_reject(F.col("toxic"))).alias("good"), F.size("checks").alias("n_checks"),
        F.array_join(F.transform(F.filter("checks", lambda x: x["fail"]), lambda x: x["kind"]), ",").alias("failed"),
    )


THRESHOLD_VERDICT = f"""WITH {SCORED_SQL}, c AS (SELECT *, sharpness < CAST(0.2 AS REAL) AS f, exposure < CAST(0.1 AS REAL) AS e, tilt_confidence >= CAST(0.2 AS REAL) AS ct,
  tilt_confidence >= CAST(0.2 AS REAL) AND abs(tilt) > 6 AS t, aesthetic IS NOT NULL AS ca, coalesce(aesthetic < CAST(0.3 AS REAL), false) AS a FROM s)
SELECT idx, NOT (f OR e OR t OR a) AS cv_good, NOT (f OR e OR t OR a) AND NOT coalesce(toxic, false) AS good, CAST(2 + CAST(ct AS INT) + CAST(ca AS INT) AS INTEGER) AS n_checks,
  concat_ws(',', CASE WHEN f THEN 'focus' END, CASE WHEN e THEN 'exposure' END, CASE WHEN t THEN 'tilt' END, CASE WHEN a THEN 'aesthetic' END) AS failed FROM c"""


def top_n_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = C.verdicts(_scored_documents(spark, sf_dir), C.Criteria(focus=0.2, aesthetic=0.3, top_n=50))
    return judged.select("idx", "score_rank", "good")


TOP_N_VERDICT = f"""WITH {SCORED_SQL}, r AS (SELECT idx, row_number() OVER (ORDER BY aesthetic DESC, idx) AS score_rank FROM s WHERE aesthetic IS NOT NULL)
SELECT s.idx, r.score_rank, coalesce(r.score_rank <= 50, false) AS good FROM s LEFT JOIN r ON s.idx = r.idx"""

QUERIES = {f.__name__: f for f in (burst_groups, burst_best_n, cull_explain, threshold_verdict, top_n_verdict)}
ORACLES = {"burst_groups": BURST_GROUPS, "burst_best_n": BURST_BEST_N, "cull_explain": CULL_EXPLAIN, "threshold_verdict": THRESHOLD_VERDICT, "top_n_verdict": TOP_N_VERDICT}
