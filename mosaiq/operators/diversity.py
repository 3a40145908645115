"""How different the texts of a group are, by words or by vectors, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import text as T
from mosaiq.functions import vectors as V
from mosaiq.operators.quantiles import counts, percentiles

THRESHOLD, MAX_RETRY = 0.25, 2
FAILED = "[failed]"


def word_counts(df: DataFrame, keys: list[str], text: str, n: int = 1) -> DataFrame:
    """``(*keys, gram, n)``: how often each run of n words occurs in a text."""
    return df.select(*keys, F.explode(T.ngrams(T.tokens(F.col(text)), n)).alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))


def clipped_overlap(words: Column, other: Column) -> Column:
    """Words of one list that the other has as well, each counted at most as often as there.

    Both lists belong to one row; a word's count is the number of its places.
    """
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    return F.aggregate(F.array_distinct(words), F.lit(0), lambda a, w: a + F.least(count(words, w), count(other, w)))


def bleu1(words: Column, other: Column) -> Column:
    """Share of the words that the other text has as well, counts clipped; 0 for no words."""
    return F.when(F.size(words) == 0, 0.0).otherwise(clipped_overlap(words, other) / F.size(words))


def pairs(df: DataFrame, group: str, ordinal: str, payload: str) -> DataFrame:
    """``(group, i, j, a, b)`` for i before j: the pairs of each group, by a join that Spark can split, whatever a group's size."""
    a = df.select(group, F.col(ordinal).alias("i"), F.col(payload).alias("a"))
    b = df.select(F.col(group).alias("__g"), F.col(ordinal).alias("j"), F.col(payload).alias("b"))
    return a.join(b, (F.col(group) == F.col("__g")) & (F.col("i") < F.col("j"))).select(group, "i", "j", "a", "b")


def lexical(df: DataFrame, group: str, ordinal: str, text: str) -> DataFrame:
    """``(group, i, j, dist)``: one minus the share of i's words that j has."""
    words = df.select(group, ordinal, T.tokens(F.col(text)).alias("w"))
    return pairs(words, group, ordinal, "w").select(group, "i", "j", (1 - bleu1(F.col("a"), F.col("b"))).alias("dist"))


def by_vectors(df: DataFrame, group: str, ordinal: str, vector: str) -> DataFrame:
    """``(group, i, j, dist)``: one minus the cosine."""
    unit = df.select(group, ordinal, V.normalise(F.col(vector)).alias("v"))
    return pairs(unit, group, ordinal, "v").select(group, "i", "j", (1 - V.dot(F.col("a"), F.col("b"))).alias("dist"))


def report(df: DataFrame, distances: DataFrame, group: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(group, n_pairs, mean_score, passed, worst_i, worst_j)`` for each group of ``df``.

    The worst pair is the closest, the first in order if several are. A group of fewer than
    two texts has no pairs, scores 0 and does not pass.
    """
    worst = F.min(F.struct("dist", "i", "j")).alias("w")
    scored = distances.groupBy(group).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("dist").alias("mean_score"), worst)
    joined = df.select(group).distinct().join(scored, group, "left")
    return joined.select(
        group, F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.col("mean_score") >= threshold, F.lit(False)).alias("passed"), F.col("w.i").alias("worst_i"), F.col("w.j").alias("worst_j"),
    )


def gate(attempts: DataFrame, threshold: float = THRESHOLD, max_retry: int = MAX_RETRY) -> DataFrame:
    """``(request, slot, attempt, text, is_valid, mean_score, passed)``: the answers that a retrying caller ends with.

    ``attempts`` has ``request, slot, attempt, text`` (attempts from 0, null for a failed
    call). Invalid slots are called again. When all are valid but too alike, the later slot
    of the closest pair is; the last attempt stands. Attempts are consumed in order, one
    per call of a slot; a slot without another one counts as failed.
    """
    every = attempts.select("request", "slot", "attempt", T.postprocess(F.col("text")).alias("p"), F.col("text").isNotNull().alias("ok"))
    every = every.select("request", "slot", "attempt", "p.text", (F.col("ok") & F.col("p.is_valid")).alias("is_valid"))
    slots = attempts.select("request", "slot").distinct().withColumn("at", F.lit(0)).withColumn("done", F.lit(False))
    for turn in range(max_retry + 1):
        now = slots.join(every.withColumnRenamed("attempt", "at"), ["request", "slot", "at"], "left")
        now = now.select("request", "slot", "at", "done", F.coalesce("text", F.lit(FAILED)).alias("text"), F.coalesce("is_valid", F.lit(False)).alias("is_valid"))
        if turn == max_retry:
            break
        full = now.groupBy("request").agg(F.min("is_valid").alias("full"))
        close = report(now, lexical(now, "request", "slot", "text"), "request", threshold)
        next_call = F.when(F.col("done"), False).when(~F.col("is_valid"), True).otherwise(F.col("full") & ~F.col("passed") & (F.col("slot") == F.col("worst_j")))
        slots = now.join(full, "request").join(close, "request").select(
            "request", "slot", (F.col("at") + F.coalesce(next_call, F.lit(False)).cast("int")).alias("at"), (F.col("done") | (F.col("full") & F.col("passed"))).alias("done")
        )
    valid = now.where("is_valid")
    final = report(now, lexical(valid, "request", "slot", "text"), "request", threshold)
    return now.join(final, "request").select("request", "slot", F.col("at").alias("attempt"), "text", "is_valid", "mean_score", "passed")


def compare_scorers(distances: DataFrame, model: str, group: str) -> DataFrame:
    """``(model, mean, median, min, max, n)`` of the groups' mean distances under several scorers."""
    means = distances.groupBy(model, group).agg(F.avg("dist").alias("m"))
    middle = percentiles(counts(means, F.col("m"), F.col(model)), [0.5]).select(F.col("g").alias(model), F.get("p", F.lit(0)).alias("median"))
    return means.groupBy(model).agg(F.avg("m").alias("mean"), F.min("m").alias("min"), F.max("m").alias("max"), F.count(F.lit(1)).alias("n")).join(middle, model).select(model, "mean", "median", "min", "max", "n")
