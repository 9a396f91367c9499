"""Extraction of files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from papertide.api import extract

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_arriving(spark: SparkSession, folder: str, pattern: str = "*", files_per_batch: int = 1_000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "content")


def extract_arriving(spark: SparkSession, folder: str, target: str, checkpoint: str, pattern: str = "*", **trigger) -> StreamingQuery:
    """Each micro-batch is extracted with the batch plans and written under its own number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        extract(batch, "path", by_path=True).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = read_arriving(spark, folder, pattern).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()
