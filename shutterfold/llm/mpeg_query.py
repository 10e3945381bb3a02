"""op6: every document as an MPEG stream, read back and digested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mpeg


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    media = mpeg.probe_column(mpeg.store_column(docs).select("doc_id", "media"))
    i = F.col("info")
    offsets = F.concat_ws(",", F.col("info.offsets").cast("array<string>"))
    return media.select(
        "doc_id",
        i["n_bytes"].alias("n_bytes"),
        F.length(i["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(i["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(i["payload"], -mpeg.UNIT, mpeg.UNIT)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("v"), i["version"], F.lit("l"), i["layer"], F.lit("@"), i["sample_rate"], F.lit("x"), i["channels"]),
            F.concat(F.lit("frames="), i["frames"], F.lit("/"), i["table_frames"]),
            F.concat(F.lit("us="), i["duration_us"]),
            F.concat(F.lit("crc="), i["crc_good"], F.lit("+"), i["crc_bad"]),
            F.concat(F.lit("skipped="), i["skipped_bytes"]),
            F.concat(F.lit("seek="), F.crc32(offsets)),
        ).alias("feature"),
        i["duration_us"].alias("duration_us"),
        i["offsets"].alias("seek_offsets"),
    )


QUERIES = {"op6_mpeg_audio": op6_mpeg_audio}
ORACLES: dict[str, str] = {}
