"""A session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "alertweave", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow for the few Python functions.

    Shuffle partitions are left to the cluster; adaptive execution coalesces them."""
    b = SparkSession.builder.appName(name)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
