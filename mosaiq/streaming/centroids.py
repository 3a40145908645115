"""Means by label kept up to date as files arrive: sums and counts a micro-batch, merged when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from mosaiq.functions import vectors as V


def add_batch(rows: DataFrame, number: int, label: str, vector: str, store: str) -> None:
    """Store the sums and counts of one micro-batch under its number; a batch that is run again replaces what it left.

    Rows without a label or vector are left out.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("cluster"), V.as_double(F.col(vector)).alias("v"))
    sums = known.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), V.sum_by_position("v").alias("total"))
    sums.coalesce(1).write.mode("overwrite").parquet(f"{store}/batch={number}")  # a row a cluster


def sum_new_files(spark: SparkSession, source: str, schema: StructType, label: str, vector: str, store: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Take in the files that have arrived since the last run; a run that is broken off repeats its last batch."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, label, vector, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, store: str) -> DataFrame:
    """``cluster, n, centroid`` over all batches so far."""
    sums = spark.read.parquet(store).groupBy("cluster").agg(F.sum("n").alias("n"), V.sum_by_position("total").alias("total"))
    return sums.select("cluster", "n", V.scale(F.col("total"), 1.0 / F.col("n")).alias("centroid"))
