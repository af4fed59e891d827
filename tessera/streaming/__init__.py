"""Arriving images as a stream of manifest candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import images


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (source_id, path, length, modificationTime) of image files as they come into ``folder``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return s.filter(F.lower("path").rlike(r"\.(" + "|".join(images.EXTENSIONS) + ")$")).select(images.stem(F.col("path")).alias("source_id"), "path", "length", "modificationTime")
