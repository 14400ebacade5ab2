"""Cleaning as a stream over a folder that files arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.filtering import clean_posts
from ..sources.files import RAW


def stream_posts(spark: SparkSession, path: str, schema: str = RAW, files_per_trigger: int = 100) -> DataFrame:
    """The cleaned posts of JSON lines files, each file once."""
    return clean_posts(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path))


def write_available(posts: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what has arrived since the last run, then stops."""
    posts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
