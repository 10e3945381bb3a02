"""op3: score every document by the model of the training folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality


def op3_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = quality.score(docs, quality.trained(docs, labels))
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted")
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents below the threshold go; the columns stay."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = quality.score(docs, quality.trained(whole, labels), out="__score")
    return scored.where(F.col("__score") >= quality.CUT).select(*docs.columns)


QUERIES = {"op3_quality_bradley_terry": op3_quality_bradley_terry}
ORACLES: dict[str, str] = {}
