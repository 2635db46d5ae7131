"""Line-delimited GeoJSON as a stream: the batch reader's parser on files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.geojson import parse_lines


def read_stream(spark: SparkSession, folder: str, properties: str, files_per_trigger: int = 100) -> DataFrame:
    """Features of new files of a folder; ``properties`` is the struct type of their properties."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_lines(lines, properties)
