"""Extension: load document files into the blob table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalith.sources.ingest import file_rows

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """A stream of (id, path, content_type, data) rows, one per new file; late copies of an id within a day are dropped."""
    raw = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)
    rows = file_rows(raw, folder, extensions, keep="modificationTime")
    return rows.withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["id"]).drop("modificationTime")


def store_arrivals(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived and stop."""
    return stream.withColumn("loaded", F.current_timestamp()).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
