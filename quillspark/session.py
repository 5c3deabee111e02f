"""Sessions with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


def session(app: str = "quillspark", **more: str) -> SparkSession:
    """The running session, or a new one."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
