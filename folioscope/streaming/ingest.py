"""The text scan over a directory that keeps receiving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioscope.sources.files import text_pages

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def stream_text_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Pages of text files as they arrive; same columns as the batch scan."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).load(directory)
    return text_pages(files)


def append_pages(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append newly arrived pages to a Parquet table, then stop."""
    return (
        pages.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
