"""Scores from similarities: anchor maxima, weighted neighbours, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators.quantiles import counts, percentiles


def anchor_max(df: DataFrame, anchors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``(id, anchor_group, raw)``: by row and group of anchors the largest cosine.

    ``anchors`` has ``anchor_group, anchor_vector``: a constant table of sentences, folded
    into one row so that each data row is read and scored once.
    """
    groups = anchors.groupBy("anchor_group").agg(F.collect_list("anchor_vector").alias("vs"))
    listed = groups.agg(F.collect_list(F.struct("anchor_group", "vs")).alias("groups"))
    rows = df.select(id_col, F.col(vector).alias("__v")).crossJoin(F.broadcast(listed))  # one row
    best = F.transform("groups", lambda g: F.struct(g["anchor_group"].alias("anchor_group"), F.array_max(F.transform(g["vs"], lambda a: V.cosine(F.col("__v"), a))).alias("raw")))
    return rows.select(id_col, F.explode(best).alias("x")).select(id_col, "x.anchor_group", "x.raw")


def pooled_percentiles(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row ``(low, high)``: percentiles of all values, groups pooled, linearly interpolated."""
    return percentiles(counts(df, F.col(column)), [low, high]).select(F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"))


def clip_scaled(df: DataFrame, column: str, ends: DataFrame, scale_max: float = 6.0) -> Column:
    """``df`` with ``score``: the column clipped to the ends and moved to 0 to ``scale_max``."""
    clipped = F.greatest(F.col("low"), F.least(F.col("high"), F.col(column)))
    score = (clipped - F.col("low")) / (F.col("high") - F.col("low")) * scale_max
    return df.crossJoin(F.broadcast(ends)).withColumn("score", score).drop("low", "high")  # one row


def weighted_neighbours(sims: DataFrame, values: list[str], key: str, every: DataFrame, least: float = 0.6) -> DataFrame:
    """``(key, *values)``: means of the neighbours' values weighted by similarities of ``least`` or more; zeros if there are none.

    ``sims`` has ``key, sim`` and the neighbours' values; ``every`` has all keys.
    """
    near = sims.where(F.col("sim") >= least)
    means = near.groupBy(key).agg(*((F.sum(F.col("sim") * F.col(v)) / F.sum("sim")).alias(v) for v in values))
    return every.select(key).join(means, key, "left").na.fill(0.0, values)


def fused(first: Column, second: Column, valid: Column, a: float, b: float) -> Column:
    """Weighted mean of two scores; without a valid first one, the second alone."""
    on = F.when(valid, F.lit(float(a))).otherwise(0.0)
    return (on * F.coalesce(first, F.lit(0.0)) + b * second) / (on + b + 1e-9)
