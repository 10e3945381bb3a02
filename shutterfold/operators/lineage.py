"""Cutting lineage through the folder that a cluster shares.

``spark.checkpoint.dir`` names it; where the setting is missing, a folder in
the warehouse stands in, which a cluster shares too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, also set as the checkpoint folder."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shutterfold-{uuid.uuid4().hex}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: small iterative state survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(spark: SparkSession) -> None:
    """Deletes what ``stored`` has written in this session; frames that read it can't be used any more."""
    system = spark._jvm.org.apache.hadoop.fs
    for path in getattr(spark.sparkContext, "_shutterfold_stored", []):
        place = system.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    spark.sparkContext._shutterfold_stored = []


def stored(df: DataFrame) -> DataFrame:
    """Writes to a compressed table in the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    context = df.sparkSession.sparkContext
    context._shutterfold_stored = [*getattr(context, "_shutterfold_stored", []), path]
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
