"""Session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session in UTC with adaptive execution; ``master`` is left to the launcher when None."""
    b = SparkSession.builder.appName("tidemark")
    if master:
        b = b.master(master).config("spark.driver.memory", memory)
    return (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
