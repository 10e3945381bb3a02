"""op10: encode and decode every document with the public 50k byte-level ranks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe

RANKS = "byte_bpe_50k.tiktoken"
STAGE_MEMO = 1 << 18  # the stages before this one have filled the executors' memory


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: ids of every text beside the columns of ``docs``, checked by decoding them."""
    return bpe.checked(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, memo=STAGE_MEMO)


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op10_byte_level_bpe": op10_byte_level_bpe}
ORACLES: dict[str, str] = {}
