"""Sessions with the settings this engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidewire", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; existing settings win over none given here."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    # checkpoints go when nothing refers to them any more
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
