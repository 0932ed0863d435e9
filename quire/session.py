"""Sessions and table registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(name: str = "quire", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC. Sizes are left to the cluster's own settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Register tables as temporary views, for Spark SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
