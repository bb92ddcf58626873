"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",  # documents are large rows
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; `more` wins over them."""
    b = SparkSession.builder.appName("vellumspark").config(map=SETTINGS | more)
    return (b.master(master) if master else b).getOrCreate()
