"""Exact percentiles and order statistics from sorted ranges of the distinct values.

``percentile`` of Spark gathers all distinct values of a group in one task. Here they are
counted, dealt out in sorted ranges, and the wanted ranks are looked up where the running
counts say, so that no task holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.runtime import saved


def _numbered(counted: DataFrame) -> DataFrame:
    """``(g, value, first, last, total)`` from ``(g, value, n)``: ranks from 0 that a value takes within its group."""
    ranged = saved(counted.repartitionByRange("g", "value").withColumn("part", F.spark_partition_id()))
    held = ranged.groupBy("g", "part").agg(F.sum("n").alias("held"))
    group = W.partitionBy("g")  # a row a range
    before = held.select("g", "part", (F.sum("held").over(group.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(group).alias("total"))
    last = F.col("before") + F.sum("n").over(W.partitionBy("g", "part").orderBy("value")) - 1
    joined = ranged.alias("r").join(before.alias("b"), F.col("r.g").eqNullSafe(F.col("b.g")) & (F.col("r.part") == F.col("b.part")))
    return joined.select("r.g", "r.part", "value", "n", "before", "total").withColumn("last", last).select("g", "value", (F.col("last") - F.col("n") + 1).alias("first"), "last", "total")


def counts(df: DataFrame, value: Column, group: Column | None = None) -> DataFrame:
    """``(g, value, n)``: how often a group has each of its values, null ones left out."""
    rows = df.select((F.lit("") if group is None else group).alias("g"), value.alias("value")).where("value IS NOT NULL")
    return rows.groupBy("g", "value").agg(F.count(F.lit(1)).alias("n"))


def percentiles(counted: DataFrame, shares: list[float]) -> DataFrame:
    """``(g, p)``: by group of :func:`counts` its percentiles in the order of ``shares``, linearly interpolated."""
    numbered = _numbered(counted)
    at = [(F.col("total") - 1) * s for s in shares]
    value = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("value").cast("double")))
    ends = [F.struct(value(F.floor(a)).alias("low"), value(F.ceil(a)).alias("high"), F.max(a - F.floor(a)).alias("part")) for a in at]
    found = numbered.groupBy("g").agg(F.array(*ends).alias("ends"))
    return found.select("g", F.transform("ends", lambda e: e["low"] + (e["high"] - e["low"]) * e["part"]).alias("p"))


def order_statistics(counted: DataFrame, ranks: list[int]) -> DataFrame:
    """``(g, rank, value)``: the values at ranks from 0 of each group; ranks beyond its size are left out."""
    wanted = F.explode(F.filter(F.array(*map(F.lit, ranks)), lambda r: (F.col("first") <= r) & (r <= F.col("last"))))
    return _numbered(counted).select("g", wanted.alias("rank"), "value")
