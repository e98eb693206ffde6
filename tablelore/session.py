"""Spark sessions for tests, benches and notebooks.

On a cluster the session comes from the platform; nothing here is needed there
except that the session time zone should be UTC.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session sized for one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablelore")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        # Recording the call site of every column expression triples planning time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
