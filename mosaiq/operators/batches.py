"""Requests cut into batch jobs by running sums of tokens, and the jobs' answers joined back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.operators.ordered import running_sums

FAILED, ERRORS = ("failed", "expired", "cancelled"), "error"


def cut(df: DataFrame, keys: Sequence[str], tokens: Column, token_cap: int, request_cap: int) -> DataFrame:
    """``df`` with ``tokens``, ``batch`` and ``place``, a request's number within its batch from 0.

    Requests of at most half the cap are cut where their running sum, in the order of
    ``keys``, passes a multiple of what the cap leaves when the largest of them is taken
    off; so no batch exceeds ``token_cap``, all but the last hold about half of it or more,
    and no cut depends on the one before. What then has more than ``request_cap`` requests
    is cut again by number. Larger requests, of which no two fit together, are batches of
    their own, even beyond the cap (``token_cap`` is then less than ``tokens``).
    A request counts for one token at least, one of null tokens too.
    """
    half = token_cap // 2
    n = F.greatest(F.coalesce(tokens.cast("long"), F.lit(1)), F.lit(1))
    rows = running_sums(df.withColumn("tokens", n), keys, F.when(F.col("tokens") <= half, F.col("tokens")), "__before", "__ord")
    small = F.col("tokens") <= half
    name = F.when(small, F.concat(F.lit("s"), F.floor(F.col("__before") / (token_cap - half + 1)))).otherwise(F.concat(F.lit("l"), "__ord"))
    rows = rows.withColumn("__cut", name)
    number = F.row_number().over(W.partitionBy("__cut").orderBy("__ord")) - 1  # a cut has token_cap requests at most
    rows = rows.withColumn("__number", number).withColumn("batch", F.concat("__cut", F.lit("-"), F.floor(F.col("__number") / request_cap)))
    return rows.withColumn("place", (F.col("__number") % request_cap).cast("long")).drop("__before", "__ord", "__cut", "__number")


def collected(answers: DataFrame, jobs: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first answer of each ``key`` in the order of ``order``, from jobs that did not fail, answers with an ``error`` left out.

    ``answers`` has ``batch`` and ``error``, ``jobs`` has ``batch`` and ``status``; a batch
    without a job has not been run, and its answers do not count. Answers of one key are
    compared in partial aggregates, never gathered.
    """
    ran = jobs.where(~F.col("status").isin(*FAILED)).select("batch").distinct()
    whole = answers.where(F.col(ERRORS).isNull()).join(ran, "batch", "left_semi")
    rest = [c for c in answers.columns if c not in (key, ERRORS)]
    first = whole.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return first.select(key, "__first.*")
