"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps TIMESTAMP and TIMESTAMP_NTZ arithmetic equal; AQE coalesces and splits shuffle partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(name: str = "lakecat", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; `more` holds further settings, dots written as double underscores."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
