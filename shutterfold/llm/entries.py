"""The registered queries of the dealt operators: thin, whole-table, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(*modules) -> None:
    for module in modules:
        QUERIES.update(module.QUERIES)
        ORACLES.update(module.ORACLES)


def load() -> None:
    from . import bpe_query, decontaminate_query, linededup_query, lmscore_query, mpeg_query, ngramjoin_query, pii_query, quality_query, urlfilter_query, viterbi_query

    _register(bpe_query, decontaminate_query, linededup_query, lmscore_query, mpeg_query, ngramjoin_query, pii_query, quality_query, urlfilter_query, viterbi_query)
    from . import centroids_query, langid_query, whitening_query

    _register(centroids_query, langid_query, whitening_query)


load()
