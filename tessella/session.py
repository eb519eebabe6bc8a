"""Session settings and table access shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings a new session starts with. A session that already exists keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """Return the active session or make one with :data:`DEFAULTS`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data folder; any store Spark can read will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
