"""Extension: the time-gap bursts of a stream, and arrivals seen once.

Not part of the batch engine's behaviour: an event later than the watermark is
dropped, and a burst comes out when the watermark has passed its end.  A gap
counts inclusively, as in the batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir


def bursts(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """``key, first, last, n`` of every closed burst."""
    grouped = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap))
    return grouped.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).drop("session_window")


def seen_once(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first arrival of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Drains what is there through a checkpointed query into a table in the shared folder, and reads that."""
    import uuid

    spark: SparkSession = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
