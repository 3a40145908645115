"""Chunked scoring as a stream over files: what has been processed is remembered by the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def score_new_files(
    spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 100
) -> StreamingQuery:
    """Transform the files that have arrived since the last run and append the results, each exactly once.

    A run that is broken off resumes after its last finished batch.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return transform(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
