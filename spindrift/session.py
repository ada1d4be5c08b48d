"""A session with the settings that the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "spindrift", **settings: str) -> SparkSession:
    """A session with adaptive plans: partitions coalesce and skewed joins split at run time."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for k, v in {**defaults, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
