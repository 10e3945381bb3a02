"""All registered queries of the collection engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue_queries, collection_queries, cull_queries, decision_queries, image_queries, measure_queries, run_queries, stream_queries

MODULES = (cull_queries, catalogue_queries, collection_queries, decision_queries, image_queries, measure_queries, run_queries, stream_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLES.items()}
