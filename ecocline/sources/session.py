"""Session settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution picks broadcast sides by measured size, splits skewed join partitions and
# merges small ones; the initial partition count is for the largest shuffles.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tuned(builder: SparkSession.Builder, **extra: str) -> SparkSession.Builder:
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder
