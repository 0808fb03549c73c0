"""Session and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "ashlar", **conf: str) -> SparkSession:
    """A session with what the library counts on: UTC, ANSI, adaptive plans. Sizes of partitions are the cluster's to set."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
