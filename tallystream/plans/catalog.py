"""All runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystream.plans import (
    distinct_queries, event_queries, frequency_queries, hitter_queries, metric_queries,
)

_MODULES = (event_queries, frequency_queries, distinct_queries, hitter_queries, metric_queries)
Query = Callable[[SparkSession, str], DataFrame]


def _runnable(query: Query) -> Query:
    """Runs in UTC and gives zone-less timestamps, so that values do not depend on the session zone."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        result = query(spark, directory)
        zoned = {f.name for f in result.schema if isinstance(f.dataType, T.TimestampType)}
        if not zoned:
            return result
        return result.select(*[
            F.col(c).cast("timestamp_ntz").alias(c) if c in zoned else F.col(c) for c in result.columns
        ])

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


def all_queries() -> dict[str, Query]:
    return {name: _runnable(query) for module in _MODULES for name, query in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.ORACLES.items()}
