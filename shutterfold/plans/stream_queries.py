"""Extension: bursts of ``events`` as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import bursts


def events_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if not _is_folder(spark, path) else "*.parquet").parquet(path if _is_folder(spark, path) else folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return bursts.run_available(bursts.bursts(stream, "user_id", "ts", "2 hours", "1 hour"), "events")


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asks the file system that holds the path, whichever it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


QUERIES = {"events_session_stream": events_session_stream}
ORACLES: dict[str, str] = {}
