"""Texts and helpers that the tests of the dealt operators share."""

import re

from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank at dusk and count stars".split()


def docs(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({"ids": F.lit("x"), "key": F.lit(1), "n": F.lit(2), "score": F.lit(3), "h": F.lit(4)}) if extra else df


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


ODD = [None, "", " ", "\n\n", "one", "One  two\tTHREE", "é漢字😀 x" * 3, "a" * 70_000, "same text here now", "same text here now"]
