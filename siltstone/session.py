"""The session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "siltstone", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow transfer; `settings` use `_` for dots."""
    builder = SparkSession.builder.appName(name)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    return builder.config(map=base | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()
