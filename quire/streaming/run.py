"""Running a streaming query over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources.shared import new_folder


def folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def stream(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """A table as a stream of its files, be it a folder or a single file: a path with a pattern may be either."""
    return spark.readStream.schema(schema).parquet(f"{root}/{name}.parque[t]")


def available_now(stream: DataFrame) -> DataFrame:
    """The rows that an append-only streaming query makes of all input that is there, as a table."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    q = stream.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", f"{at}/checkpoint").format("parquet").start(f"{at}/rows")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
