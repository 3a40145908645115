"""Importance resampling towards the word statistics of a target corpus.

Features are runs of words, hashed into buckets. A bucket's gain is the rounded log ratio of
its smoothed frequencies in the target and in all documents; a document's weight is the sum
of its features' gains, looked up in an array with one entry a bucket. Gumbel noise of a
seeded hash of the id makes the highest scores a weighted draw without replacement.

Which documents are drawn is settled without sorting them: the composite key of score and
id of the last one drawn is found digit by digit from counts
(:func:`mosaiq.operators.ordered.first_k`). Only what is drawn is sorted, in ranges, and
ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm._common import written
from mosaiq.llm._terms import Buckets
from mosaiq.operators.ordered import first_k, ordinals
from mosaiq.runtime import ship

#: Words of a feature at most, buckets, the noise's seed, and gains and noise are multiples of a thousandth.
RUN, BUCKETS, SEED, UNIT = 1, 10_000, 2024, 1000
#: Buckets at most: gains travel to each task, counts to the driver.
MAX_BUCKETS = 1 << 20
#: Words a document must have to be drawn, and the share that is drawn.
LEAST_WORDS, PERCENT = 20, 10


@dataclass
class Gains:
    """By bucket, what a feature adds to a document's weight."""

    gains: list[int]
    run: int


def bucket_counts(texts: DataFrame, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall into each bucket: a task sends one row a bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, total = Buckets(run, buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for data in batch["text"]:
                total += np.bincount(found.of(data)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    ship(texts.sparkSession)
    parts = texts.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).mapInPandas(count, "bucket long, n long")
    counts = [0] * buckets
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        counts[r["bucket"]] = r["n"]
    return counts


def fit(docs: DataFrame, target: DataFrame, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> Gains:
    """Gains of the buckets from all documents and all target texts; a null text has no features."""
    if not 0 < buckets <= MAX_BUCKETS or run < 1:
        raise ValueError(f"there are 1 to {MAX_BUCKETS} buckets, and features have a word at least")
    source, wanted = (bucket_counts(df, text_col, run, buckets) for df in (docs, target))
    all_source, all_wanted = sum(source) + buckets, sum(wanted) + buckets
    return Gains([math.floor(UNIT * math.log((t + 1) * all_source / ((s + 1) * all_wanted))) for s, t in zip(source, wanted)], run)


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of seed and id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(2.0**32))))


def score(docs: DataFrame, gains: Gains, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``(row_id, n_words, n_features, weight, score)`` by row of ``docs``; a null text has no words and weight 0."""
    ship(docs.sparkSession)
    run, of = gains.run, docs.sparkSession.sparkContext.broadcast(np.array(gains.gains, dtype=np.int64))  # an entry a bucket

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = Buckets(run, len(of.value))
        for batch in batches:
            rows = [(n, len(at), int(of.value[at].sum())) for at, n in map(found.of, batch)]
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"], dtype="int64")

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    weighed = docs.select(F.col(id_col).alias("row_id"), weigh(text).alias("w"))
    return weighed.select("row_id", "w.*", (F.col("w.weight") + noise(F.col("row_id"), seed)).alias("score"))


def resample(
    docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT,
    least_words: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_features, weight, score, rank``.

    Of the N rows with ``least_words`` words, the ``floor(percent * N / 100)`` of the highest
    scores are drawn and ranked from 1, equal scores by ascending id, which must be an
    integer; a null id comes last. Of rows that repeat an id and a score, those with fewer
    features come first; where these agree too, the rows' results are the same but for the
    rank. Rows that are not drawn have a null rank. An empty target makes all gains those of
    a target without features; an empty table gives an empty result. Other columns are not
    read.

    Texts are read twice, once for the counts and once for the weights, and move nowhere;
    what is stored, counted by digit and sorted is a few numbers a document.
    """
    gains = fit(docs, target, text_col, run, buckets)
    scored = score(docs, gains, text_col, id_col, seed)
    keys = {"down": F.bitwise_not("score"), "nameless": F.col("row_id").isNull().cast("long"), "id": F.coalesce(F.col("row_id").cast("long"), F.lit(0)), "n_features": F.col("n_features"), "place": F.monotonically_increasing_id()}
    rows = written(scored.withColumns(keys))
    fit_rows = rows.where(F.col("n_words") >= least_words)
    chosen = first_k(fit_rows, list(keys), fit_rows.count() * percent // 100)
    drawn = ordinals(rows.where((F.col("n_words") >= least_words) & chosen), list(keys), "rank")
    rest = rows.where((F.col("n_words") < least_words) | ~chosen).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("row_id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that :func:`resample` drew, texts and all, unordered: rows whose id has a rank.

    Ids are looked up by a join that Spark may split; of rows that repeat an id all come
    where one is drawn.
    """
    ids = ranked.where("rank IS NOT NULL").select(F.col(id_col).alias("__drawn")).distinct()
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("__drawn")), "left_semi")
