"""The session settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",  # later keys override earlier ones in merged maps
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "textloom", **more: str) -> SparkSession:
    """A session with these settings; anything else comes from the cluster's own configuration."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


def configured(spark: SparkSession) -> SparkSession:
    """Applies the settings that can change at run time to a session that someone else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
