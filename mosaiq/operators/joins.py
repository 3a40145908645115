"""Putting tables side by side by their ids, never by row position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import text as T


def align(left: DataFrame, right: DataFrame, key: str, vector: str, dim: int, missing: str = "error") -> DataFrame:
    """``left`` with the right side's vector. ``missing``: ``error``, ``drop`` or ``zero`` for ids without one."""
    if missing == "zero":
        return left.join(right.select(key, vector), key, "left").withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0), dim).cast(right.schema[vector].dataType)))
    if missing == "error" and not left.join(right, key, "left_anti").isEmpty():
        raise KeyError(f"ids of the left side have no {vector}")
    return left.join(right.select(key, vector), key)


def merge_labels(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Inner join of two label tables, and how many of the first one's rows it loses."""
    return a.join(b, key), a.join(b, key, "left_anti").count()


def attach_score(cards: DataFrame, scores: DataFrame, key: str, score: str, default: float = 0.0) -> DataFrame:
    """``cards`` with a score read as a number; bad numbers are skipped, of several the last in ``ord`` counts, none gives the default."""
    good = scores.withColumn("__s", F.expr(f"try_cast({score} AS double)")).where("__s IS NOT NULL")
    last = good.groupBy(key).agg(F.max_by("__s", "ord").alias(score)) if "ord" in scores.columns else good.groupBy(key).agg(F.max("__s").alias(score))
    return cards.join(last, key, "left").withColumn(score, F.coalesce(score, F.lit(default)))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.join(b, key, "left_anti").isEmpty() and b.join(a, key, "left_anti").isEmpty()


def cached_or_recomputed(wanted: DataFrame, cache: DataFrame, key: str, recompute) -> DataFrame:
    """The cache's rows for the wanted ids if it has them all; else ``recompute(wanted)``."""
    if wanted.join(cache, key, "left_anti").isEmpty():
        return cache.join(wanted.select(key), key, "left_semi")
    return recompute(wanted)


def scenario(main: DataFrame, derived: DataFrame, wanted: str) -> DataFrame:
    """The scenario of an id given as text, from the main list or else the derived one."""
    both = main.withColumn("__o", F.lit(0)).unionByName(derived.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    return both.where(F.col("id").cast("string") == wanted).orderBy("__o").limit(1).drop("__o")


def scenarios(main: DataFrame, derived: DataFrame, wanted: DataFrame) -> DataFrame:
    """The scenario of each id of ``wanted`` (``id``, text), from the main list or else the derived one; ids in neither are left out.

    Both lists have an ``id`` of any type, ids unique within a list, and the same other columns.
    """
    other = [c for c in main.columns if c != "id"]
    both = main.withColumn("id", F.col("id").cast("string")).withColumn("__o", F.lit(0)).unionByName(derived.withColumn("id", F.col("id").cast("string")).withColumn("__o", F.lit(1)))
    met = both.join(wanted.select("id").distinct(), "id", "left_semi")
    return met.groupBy("id").agg(F.min_by(F.struct(*other), "__o").alias("x")).select("id", "x.*")


def equal_to(df: DataFrame, column: str, value: float) -> DataFrame:
    """Rows whose column, read as a number, is the value itself; what is no number is not."""
    return df.where(F.expr(f"try_cast({column} AS double)") == value)


def tidy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns without white space at their ends; null stays null."""
    return df.withColumns({c: F.regexp_replace(F.col(c).cast("string"), T.ENDS, "") for c in columns})
