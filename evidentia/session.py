"""Session settings of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python workers small: texts and pages of some KB make a few MB of 1,000 rows, and what a
    worker holds does not grow with its partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= int(SETTINGS[name]):
        spark.conf.set(name, SETTINGS[name])


def session(name: str = "evidentia", **extra: str) -> SparkSession:
    """A session in UTC with adaptive plans; ``extra`` settings win.  Partition counts stay the cluster's."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
