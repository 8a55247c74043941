"""Session construction with the settings every query assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidewheel", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    return builder.config(map=settings).getOrCreate()
