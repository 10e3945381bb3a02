"""op13: the first eight whitened components of every usable embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import whitening

COMPONENTS = 8


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it doesn't fit in a long; ``deviation_exact`` always has it."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whitening.whiten(vectors, COMPONENTS).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error",
        F.col("deviation").alias("deviation_exact"),
    )


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLES: dict[str, str] = {}
