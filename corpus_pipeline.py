"""Five stages that turn raw documents into encoded training text.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written to the shared folder and read back before the next one starts, so a
lost executor never recomputes an earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shutterfold.llm import bpe_query, decontaminate_query, linededup_query, ngramjoin_query, quality_query
from shutterfold.operators.lineage import stored

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_query.keep_good),
    ("line dedup", linededup_query.drop_repeated_lines),
    ("n-gram Jaccard join", ngramjoin_query.keep_one_of_each),
    ("benchmark decontamination", decontaminate_query.drop_leaking),
    ("byte-level BPE", bpe_query.encoded),
]

#: A trained model and a tokenizer are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
