"""The session that queries and tests run in."""

from __future__ import annotations

from pyspark.sql import SparkSession

from canvass.errors import EnvironmentFault


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may do without one being set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise EnvironmentFault("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/checkpoints/canvass-{spark.sparkContext.applicationId}"


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; partitions follow the cluster unless given."""
    builder = SparkSession.builder.appName("canvass").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
