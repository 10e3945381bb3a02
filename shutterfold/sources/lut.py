"""``.cube`` colour tables: parsing one, and listing a folder of them with a status each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(text: str) -> dict:
    """``size, low, high, values`` of a 3-D table; ValueError says what is wrong."""
    size, low, high, values = 0, (0.0,) * 3, (1.0,) * 3, []
    for line in (x.split("#")[0].strip() for x in text.splitlines()):
        if not line:
            continue
        word, *rest = line.split()
        if word == "LUT_1D_SIZE":
            raise ValueError("a 1-D table")
        if word == "LUT_3D_SIZE":
            size = int(rest[0])
        elif word in ("DOMAIN_MIN", "DOMAIN_MAX"):
            numbers = tuple(map(float, rest[:3]))
            low, high = (numbers, high) if word == "DOMAIN_MIN" else (low, numbers)
        elif word[0].isdigit() or word[0] in "+-.":
            values.append(tuple(map(float, [word, *rest][:3])))
    if not 2 <= size <= 64:
        raise ValueError("size out of range")
    if len(values) != size**3 or any(len(v) != 3 or not all(map(math.isfinite, v)) for v in values):
        raise ValueError("wrong number of rows")
    if len(low) != 3 or len(high) != 3 or any(not (b > a) for a, b in zip(low, high, strict=True)):
        raise ValueError("empty domain")
    return {"size": size, "low": low, "high": high, "values": values}


def listing(spark: SparkSession, folder: str, cap: int = 500) -> DataFrame:
    """``path, name, ok, problem`` of the visible tables of a folder by name; the first ``cap`` of them."""

    @F.udf("string", useArrow=True)
    def problem(text: str) -> str | None:
        try:
            parse(text)
        except (ValueError, IndexError) as e:
            return str(e)
        return None

    files = spark.read.text(f"{folder.rstrip('/')}/*.cube", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"[^/]*$", 0).alias("name"), F.input_file_name().alias("path"), "value")
    shown = files.where(~F.col("name").startswith(".")).orderBy(F.lower("name"), "path").limit(cap)
    return shown.select("path", "name", problem("value").alias("problem")).withColumn("ok", F.col("problem").isNull())
