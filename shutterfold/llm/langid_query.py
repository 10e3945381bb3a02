"""op11: the language of every document by the model of the training folds."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid

MODEL = "piece_bpe_32k.model"


def held_out(doc_id: str = "doc_id"):
    """Rows that training must not see; those without an id too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out()), public_tokenizers.path(MODEL))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op11_language_id": op11_language_id}
ORACLES: dict[str, str] = {}
