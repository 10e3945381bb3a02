"""op5: pieces of every document by the public 32k piece table under unigram scoring."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import viterbi

MODEL = "piece_bpe_32k.model"


def op5_token_counts_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = viterbi.count_tokens(docs, public_tokenizers.path(MODEL))
    return counted.select("doc_id", "counted.n_tokens", "counted.score")


QUERIES = {"op5_token_counts_viterbi": op5_token_counts_viterbi}
ORACLES: dict[str, str] = {}
