"""Naming clusters, flagging doubtful rows, typing rows by their nearest centroids."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators.quantiles import counts, percentiles
from mosaiq.runtime import saved

LOW_MARGIN = 0.05
NOISE_PERCENT = 10
#: Labels up to which all assignments are listed; more are assigned by augmenting paths on the driver.
MOST_LISTED = 7
MOST_LABELS = 2000


def centroids(df: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """``(group, centroid, n)``: element-wise means of the vectors of ``dim`` components, summed partially in each task and then merged."""
    return df.where(F.size(vector) == dim).groupBy(group).agg(V.mean_by_position(vector).alias("centroid"), F.count(F.lit(1)).alias("n"))


def overall_mean(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """One row, ``mean``: the element-wise mean of all vectors of ``dim`` components; none for an empty table."""
    return df.where(F.size(vector) == dim).groupBy(F.lit(1).alias("one")).agg(V.mean_by_position(vector).alias("mean")).drop("one")


def with_empty(found: DataFrame, ids: DataFrame, group: str, dim: int) -> DataFrame:
    """Every id of ``ids`` with its centroid; the zero vector where the cluster is empty."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return ids.join(found, group, "left").withColumns({"centroid": F.coalesce("centroid", zero), "n": F.coalesce("n", F.lit(0))})


def similarity_matrix(anchors: DataFrame, clusters: DataFrame, mean: DataFrame) -> DataFrame:
    """``(anchor, cluster, sim)``: cosine after both sides have had the data's mean taken off.

    ``anchors`` has ``anchor, vector``; ``clusters`` has ``cluster, centroid``; ``mean`` has one
    row. Each has a row per label, so the product of the sides is small whatever the data.
    """
    unit = lambda c: V.normalise(V.subtract(F.col(c), F.col("mean")))
    a = anchors.crossJoin(mean).select("anchor", unit("vector").alias("a"))
    c = clusters.crossJoin(mean).select("cluster", unit("centroid").alias("c"))
    return a.crossJoin(c).select("anchor", "cluster", V.dot(F.col("a"), F.col("c")).alias("sim"))


def assign(sims: DataFrame) -> DataFrame:
    """``(anchor, cluster, sim)`` of the one-to-one assignment with the largest total similarity.

    ``sims`` has every pair of as many anchors as clusters. Up to ``MOST_LISTED`` of them
    all permutations are compared in Spark, ties going to the first in order; up to
    ``MOST_LABELS`` the matrix comes to the driver.
    """
    spark = sims.sparkSession
    k = sims.select("anchor").distinct().count()
    if k == 0:
        return sims.select("anchor", "cluster", "sim")
    if k > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    ranked = sims.withColumn("i", F.dense_rank().over(W.orderBy("anchor")) - 1).withColumn("j", F.dense_rank().over(W.orderBy("cluster")) - 1)
    if k <= MOST_LISTED:
        listed = spark.createDataFrame([(n, i, j) for n, p in enumerate(permutations(range(k))) for i, j in enumerate(p)], "n int, i int, j int")
        best = ranked.join(listed, ["i", "j"]).groupBy("n").agg(F.sum("sim").alias("total")).orderBy(F.desc("total"), "n").limit(1)
        return ranked.join(listed.join(best, "n"), ["i", "j"]).select("anchor", "cluster", "sim")
    rows = ranked.select("i", "j", "sim").collect()
    cost = np.zeros((k, k))
    for r in rows:
        cost[r["i"], r["j"]] = -r["sim"]
    chosen = spark.createDataFrame([(i, int(j)) for i, j in enumerate(least_cost(cost))], "i int, j int")
    return ranked.join(chosen, ["i", "j"]).select("anchor", "cluster", "sim")


def least_cost(cost: np.ndarray) -> np.ndarray:
    """For each row its column in the assignment of least total cost: shortest augmenting paths, one row at a time."""
    n = len(cost)
    row_price, col_price, row_of = np.zeros(n), np.zeros(n), np.full(n, -1)
    for start in range(n):
        reach, via, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, dtype=bool)
        i, low, last = start, 0.0, -1
        while last < 0:
            slack = low + cost[i] - row_price[i] - col_price
            better = ~done & (slack < reach)
            reach[better], via[better] = slack[better], i
            j = int(np.argmin(np.where(done, np.inf, reach)))
            low, done[j] = reach[j], True
            if row_of[j] < 0:
                last = j
            else:
                i = row_of[j]
        row_price[start] += low
        for j in np.flatnonzero(done & (np.arange(n) != last)):
            row_price[row_of[j]] += low - reach[j]
            col_price[j] -= low - reach[j]
        while True:  # shift the rows along the path
            i = via[last]
            previous = np.flatnonzero(row_of == i)
            row_of[last] = i
            if i == start:
                break
            last = int(previous[previous != last][0])
    answer = np.empty(n, dtype=int)
    answer[row_of] = np.arange(n)
    return answer


def margins(sims: DataFrame, low: float = LOW_MARGIN) -> DataFrame:
    """``(anchor, margin, low_conf)``: by anchor the largest similarity minus the second, wherever it was assigned."""
    m = V.margin(F.collect_list("sim"))
    return sims.groupBy("anchor").agg(m.alias("margin")).withColumn("low_conf", F.col("margin") < low)


def assignment_quality(assigned: DataFrame, margin: DataFrame) -> DataFrame:
    """One row: least and mean similarity of the assigned pairs, least margin."""
    return assigned.agg(F.min("sim").alias("min_cos"), F.avg("sim").alias("mean_cos")).crossJoin(margin.agg(F.min("margin").alias("min_margin")))


def medoids(df: DataFrame, group: str, id_col: str, vector: str, dim: int, n: int = 1) -> DataFrame:
    """``(group, id, rank, distance)``: the n members nearest to their cluster's mean, ties by id."""
    means = centroids(df, group, vector, dim).select(group, "centroid")
    away = df.join(means, group).select(group, id_col, V.euclidean(F.col(vector), F.col("centroid")).alias("distance"))
    rank = F.row_number().over(W.partitionBy(group).orderBy("distance", id_col))
    return away.withColumn("rank", rank).where(F.col("rank") <= n)


def medoid_and_others(df: DataFrame, group: str, id_col: str, vector: str, dim: int, n: int, seed: str = "42") -> DataFrame:
    """By cluster its medoid (rank 0) and n others in the order of a seeded hash."""
    first = medoids(df, group, id_col, vector, dim, 1).select(group, id_col, F.lit(0).alias("rank"))
    rest = df.select(group, id_col).join(first.select(group, id_col), [group, id_col], "left_anti")
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col))), id_col))
    return first.unionByName(rest.withColumn("rank", rank).where(F.col("rank") <= n))


def soft_entropy(distances: Column) -> Column:
    """Entropy in nats of shares in proportion to inverse distances; distances are raised to 1e-8 first."""
    inverse = F.transform(distances, lambda d: 1.0 / F.greatest(d, F.lit(1e-8)))
    share = F.transform(inverse, lambda x: x / V.total(inverse))
    return -V.total(F.transform(share, lambda p: p * F.ln(F.greatest(p, F.lit(1e-12)))))


def noise_by_entropy(df: DataFrame, vector: str, centres: DataFrame, percent: float = NOISE_PERCENT, carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``entropy`` and ``noise_dist`` (1 from the (100 - percent)th percentile on, inclusive).

    ``centres`` has ``centroid``, a row per cluster. Entropies are computed once and stored
    with the columns of ``df``; ``carry`` names those that are wanted, all by default.
    """
    listed = centres.agg(F.collect_list("centroid").alias("centres"))
    away = F.transform("centres", lambda c: V.euclidean(F.col(vector), c))
    wanted = df.columns if carry is None else carry
    scored = saved(df.crossJoin(F.broadcast(listed)).withColumn("entropy", soft_entropy(away)).select(*wanted, "entropy"))  # one row
    cut = percentiles(counts(scored, F.col("entropy")), [1 - percent / 100]).select(F.get("p", F.lit(0)).alias("cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn("noise_dist", (F.col("entropy") >= F.col("cut")).cast("int")).drop("cut")  # one row


def consensus_noise(df: DataFrame, signals: dict[str, str], share: float) -> DataFrame:
    """``df`` with ``flags`` and ``noise_struct``: flagged by all signals, or all but one.

    ``signals`` names columns and the suspicious side, ``low`` or ``high``; a signal flags
    the ``share`` of rows at that end, inclusive.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in signals))).alias("s")
    ends = percentiles(counts(df.select(each), F.col("s.x"), F.col("s.name")), [share, 1 - share])
    cuts = ends.agg(*(F.max(F.when(F.col("g") == c, F.get("p", F.lit(0 if side == "low" else 1)))).alias(f"__{c}") for c, side in signals.items()))
    flag = [F.coalesce((F.col(c) <= F.col(f"__{c}")) if side == "low" else (F.col(c) >= F.col(f"__{c}")), F.lit(False)).cast("int") for c, side in signals.items()]
    flags = sum(flag[1:], flag[0])
    flagged = df.crossJoin(F.broadcast(cuts)).withColumn("flags", flags)  # one row
    return flagged.withColumn("noise_struct", F.col("flags") >= len(signals) - 1).drop(*(f"__{c}" for c in signals))


def rescaled_centroids(centres: DataFrame, values: DataFrame, columns: list[str], width: float = 1.5, low: float = 1.0, high: float = 7.0) -> DataFrame:
    """``centres`` with each column moved from its own range to the data's mean less and plus ``width`` deviations.

    The deviation is the population's; the ends stay within ``low`` and ``high``. A column
    that is the same for all centroids counts as having a range of 1e-9.
    """
    facts = values.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    ranges = centres.agg(*(F.min(c).alias(f"a_{c}") for c in columns), *(F.max(c).alias(f"b_{c}") for c in columns))
    joined = centres.crossJoin(facts).crossJoin(ranges)

    def moved(c: str) -> Column:
        end = lambda sign: F.least(F.lit(high), F.greatest(F.lit(low), F.col(f"m_{c}") + sign * width * F.col(f"s_{c}")))
        span = F.col(f"b_{c}") - F.col(f"a_{c}")
        part = (F.col(c) - F.col(f"a_{c}")) / F.when(span == 0, 1e-9).otherwise(span)
        return (end(-1) + part * (end(1) - end(-1))).alias(c)

    return joined.select(*(c for c in centres.columns if c not in columns), *map(moved, columns))


def top2_types(df: DataFrame, vector: Column, centres: DataFrame, keep: list[str], threshold: float = 0.95) -> DataFrame:
    """``(*keep, type1, type2, top1_sim, top2_sim)`` by cosine with predefined centroids.

    ``centres`` has ``type, centroid``. Rows whose best similarity is below the threshold go;
    where only the second is below, ``type2`` is null. Ties go to the type listed last.
    """
    listed = centres.agg(F.sort_array(F.collect_list(F.struct("type", "centroid"))).alias("centres"))
    unit = df.select(*keep, V.normalise(vector, added=True).alias("__v")).crossJoin(F.broadcast(listed))  # one row
    sims = F.sort_array(F.transform("centres", lambda c: F.struct(V.dot(F.col("__v"), V.normalise(c["centroid"], added=True)).alias("sim"), c["type"].alias("type"))), asc=False)
    best = unit.select(*keep, sims.alias("s")).select(*keep, F.get("s", F.lit(0)).alias("a"), F.get("s", F.lit(1)).alias("b"))
    return best.where(F.col("a.sim") >= threshold).select(
        *keep, F.col("a.type").alias("type1"), F.when(F.col("b.sim") >= threshold, F.col("b.type")).alias("type2"), F.col("a.sim").alias("top1_sim"), F.col("b.sim").alias("top2_sim")
    )


def mapped(df: DataFrame, mapping: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """``df`` with ``label`` from ``mapping`` (``key, label``); unmapped keys get null, or are refused if ``strict``."""
    if strict and not df.select(key).distinct().join(mapping.where("label IS NOT NULL AND label <> ''"), key, "left_anti").isEmpty():
        raise ValueError(f"a {key} has no label")
    return df.join(mapping.select(key, "label"), key, "left")
