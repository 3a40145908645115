"""Tables of statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from mosaiq.functions import vectors as V
from mosaiq.operators.quantiles import counts, order_statistics, percentiles
from mosaiq.runtime import saved, ship

#: Components of the vectors that every task is sent at a time (32 MB of doubles), and pairs that a task compares with them.
SLAB_COMPONENTS, PAIRS = 4_000_000, 1 << 27
#: Rows, and vectors of a slab, that a task compares at a time.
HEIGHT, WIDTH = 256, 2048


def crosstab(df: DataFrame, row: str, column: str, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """``(row, column, n)`` for the whole grid of ``rows`` and ``columns``, zeros included."""
    counted = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    grid = rows.select(row).distinct().crossJoin(columns.select(column).distinct())
    return grid.join(counted, [row, column], "left").na.fill(0, ["n"])


def value_shares(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """``(column, n, share)`` of the most frequent values, ties by value."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), column).limit(n)  # one row


def imbalance(sizes: DataFrame, most: float = 0.5, least: float = 0.05) -> DataFrame:
    """One row from ``(n)`` by cluster: shares of the largest and smallest, their ratio, and warnings."""
    s = sizes.agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.sum("n").alias("all"))
    return s.select(
        (F.col("hi") / F.col("all")).alias("max_share"), (F.col("lo") / F.col("all")).alias("min_share"), (F.col("lo") / F.col("hi")).alias("balance"),
        (F.col("hi") / F.col("all") > most).alias("too_large"), (F.col("lo") / F.col("all") < least).alias("too_small"),
    )


def bundle(column: str) -> list[Column]:
    """Aggregates ``mean, p50, p95, min, max, n`` for groups of bounded size, such as trials; all zero for no values."""
    c = F.col(column)
    p = lambda q: F.percentile(c, F.lit(q))
    return [F.coalesce(x, F.lit(0.0)).alias(k) for k, x in (("mean", F.avg(c)), ("p50", p(0.5)), ("p95", p(0.95)), ("min", F.min(c)), ("max", F.max(c)))] + [F.count(c).alias("n")]


#: Further statistics for :func:`bundle_by`: percentiles by name.
PERCENTILES = {"p50": 0.5, "p95": 0.95}


def bundle_by(df: DataFrame, group: str, column: str, overall: str = "ALL", shares: dict[str, float] | None = None, over: float | None = None) -> DataFrame:
    """``(group, mean, *shares, min, max, std, n)`` by group and over all rows; zeros for groups without values.

    ``shares`` names percentiles, p50 and p95 as a rule; ``over`` adds ``over``, the share of
    values above a limit. Values are counted once, and all else comes from the counts.
    """
    shares = shares or PERCENTILES
    name = F.coalesce(F.col(group).cast("string"), F.lit(None))
    rows = df.select(F.explode(F.array(F.struct(F.lit(False).alias("every"), name.alias("name")), F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("name")))).alias("g"), F.col(column).alias("value"))
    counted = saved(rows.groupBy("g", "value").agg(F.count(F.lit(1)).alias("n")))
    x, n = F.col("value").cast("double"), F.when(F.col("value").isNotNull(), F.col("n"))
    facts = counted.groupBy("g").agg(F.sum(x * n).alias("s1"), F.sum(n).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(F.when(x > (over or 0.0), n)).alias("above"))
    mean = facts.select(F.col("g").alias("mg"), (F.col("s1") / F.col("n")).alias("m"))
    far = counted.join(mean, F.col("g").eqNullSafe(F.col("mg"))).groupBy("g").agg(F.sum((x - F.col("m")) * (x - F.col("m")) * n).alias("s2"))
    p = percentiles(counted.where("value IS NOT NULL"), list(shares.values()))
    joined = facts.alias("f").join(p.alias("p"), F.col("f.g").eqNullSafe(F.col("p.g")), "left").join(far.alias("a"), F.col("f.g").eqNullSafe(F.col("a.g")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        F.when(F.col("f.g.every"), overall).otherwise(F.col("f.g.name")).alias(group), zero(F.col("s1") / F.col("f.n")).alias("mean"),
        *(zero(F.get("p.p", F.lit(i))).alias(k) for i, k in enumerate(shares)), zero(F.col("min")).alias("min"), zero(F.col("max")).alias("max"),
        zero(F.sqrt(F.col("s2") / F.nullif(F.col("f.n") - 1, F.lit(0)))).alias("std"), *([zero(F.col("above") / F.col("f.n")).alias("over")] if over is not None else []),
        F.coalesce("f.n", F.lit(0)).alias("n"),
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, count, mean, std, min, p25, p50, p75, max)`` of numeric columns; the deviation is the sample's."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")
    found = bundle_by(df.select(each).select("s.column", "s.x"), "column", "x", "", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return found.where(F.col("column").isin(columns)).select("column", F.col("n").alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max")


def pivoted(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """One row per ``row`` and a column per value of ``column``: the first ``value`` of each pair, null where there is none."""
    return df.groupBy(row).pivot(column, columns).agg(F.min(value))


def loss_curve(df: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """``(threshold, share)``: share of rows below each threshold, in one pass."""
    t = F.array(*map(F.lit, thresholds))
    below = df.agg(F.array(*(F.avg((F.col(column) < x).cast("double")) for x in thresholds)).alias("s"))
    return below.select(F.explode(F.arrays_zip(t.alias("threshold"), F.col("s").alias("share"))).alias("x")).select("x.threshold", "x.share")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in order: a minimum with partial aggregation, not a sort of each group."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*order, F.struct(*rest).alias("row")))
    return df.groupBy(*keys).agg(first.alias("f")).select(*keys, *(F.col(f"f.row.{c}").alias(c) for c in rest)).select(df.columns)


def prefix_saturation(rows: DataFrame, items: DataFrame, ordinal: str, item: str, checkpoints: list[int], least_growth: float = 5.0) -> DataFrame:
    """``(prefix, n_unique, growth, saturated)``: distinct items among the first rows, and where growth first falls below ``least_growth`` percent.

    ``rows`` has every row once, in the order of ``ordinal``; the last prefix is all of them.
    An item counts from the smallest ordinal it occurs at, so the prefixes cost one
    aggregation. A prefix ends at the ordinal of its last row, whatever ordinals there are.
    """
    total = rows.count()
    points = sorted({*(c for c in checkpoints if 0 < c < total), total} - {0})
    ends = order_statistics(counts(rows, F.col(ordinal)), [p - 1 for p in points]).select((F.col("rank") + 1).alias("prefix"), F.col("value").alias("end"))
    firsts = items.groupBy(item).agg(F.min(ordinal).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("new"))
    listed = ends.agg(F.sort_array(F.collect_list(F.struct("end", "prefix"))).alias("ends"))  # one row, a few prefixes
    met = firsts.crossJoin(F.broadcast(listed)).select(F.explode(F.filter("ends", lambda e: F.col("at") <= e["end"])["prefix"]).alias("prefix"), "new")
    grown = ends.join(met.groupBy("prefix").agg(F.sum("new").alias("n")), "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n_unique"))
    before = F.coalesce(F.lag("n_unique").over(W.orderBy("prefix")), F.lit(0))
    grown = grown.withColumn("before", before).withColumn("growth", (F.col("n_unique") - F.col("before")) / F.greatest("before", F.lit(1)) * 100)
    slow = F.min(F.when((F.col("before") > 0) & (F.col("growth") < least_growth), F.col("prefix"))).over(W.partitionBy())
    return grown.select("prefix", "n_unique", "growth", F.coalesce(F.col("prefix") == slow, F.lit(False)).alias("saturated"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari``: agreement of two labellings of the same rows, from counts of label pairs."""
    cells = saved(pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))  # three aggregates follow
    two = lambda c: F.sum(c * (c - 1) / 2)
    n = F.col("n").cast("double")
    index = cells.agg(two(n).alias("index"), F.sum(n).alias("all"))
    rows = cells.groupBy(a).agg(F.sum(n).alias("n")).agg(two(n).alias("ra"))
    cols = cells.groupBy(b).agg(F.sum(n).alias("n")).agg(two(n).alias("rb"))
    expected = F.col("ra") * F.col("rb") / (F.col("all") * (F.col("all") - 1) / 2)
    best = (F.col("ra") + F.col("rb")) / 2
    return index.crossJoin(rows).crossJoin(cols).select(F.when(best == expected, 1.0).otherwise((F.col("index") - expected) / (best - expected)).alias("ari"))


@F.arrow_udf(S.DoubleType())
def _gap(x: pa.Array, y: pa.Array) -> pa.Array:
    """Euclidean distances of vectors, all of one length, row by row."""
    if not len(x):
        return pa.array([], pa.float64())
    a, b = (v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1) for v in (x, y))
    return pa.array(np.linalg.norm(a - b, axis=1))


def cluster_quality(df: DataFrame, label: str, vector: str, dim: int) -> DataFrame:
    """One row ``(k, n, davies_bouldin, calinski_harabasz)`` of given labels, Euclidean; two scans of ``df``."""
    ship(df.sparkSession)
    df = df.where(F.size(vector) == dim)
    means = saved(df.groupBy(label).agg(V.mean_by_position(vector).alias("c"), F.count(F.lit(1)).alias("n")))
    away = df.select(label, vector).join(F.broadcast(means.select(label, "c")), label)  # a row per cluster
    spread = away.select(label, _gap(F.col(vector), F.col("c")).alias("d")).groupBy(label).agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("within"))
    every = means.select(V.scale(F.col("c"), F.col("n")).alias("c"), "n").agg(V.sum_by_position("c").alias("s"), F.sum("n").alias("all")).select(V.scale(F.col("s"), 1 / F.col("all")).alias("m"))
    facts = saved(means.join(spread, label).crossJoin(every))  # a row per cluster
    a, b = facts.alias("a"), facts.alias("b")
    ratio = (F.col("a.s") + F.col("b.s")) / V.euclidean(F.col("a.c"), F.col("b.c"))
    worst = a.join(b, F.col(f"a.{label}") != F.col(f"b.{label}")).groupBy(f"a.{label}").agg(F.max(ratio).alias("w")).agg(F.avg("w").alias("davies_bouldin"))
    between = V.euclidean(F.col("c"), F.col("m"))
    sums = facts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("within").alias("w"), F.sum(F.col("n") * between * between).alias("b"))
    ch = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return sums.crossJoin(worst).select("k", "n", "davies_bouldin", ch.alias("calinski_harabasz"))


def silhouette(df: DataFrame, id_col: str, label: str, vector: str) -> DataFrame:
    """One row ``silhouette``, Euclidean: every pair of rows is compared, so its time grows with the square of the rows.

    Rows are dealt to tasks by a hash of their ids and stored. Slabs of them travel to every
    task, one at a time; a task sums its rows' distances from the slab by cluster, so of
    several slabs there are as many sums as clusters for each row. Rows without a label or a
    vector are left out; vectors are of one length.
    """
    ship(df.sparkSession)
    there = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label"), V.as_double(F.col(vector)).alias("v"))
    facts = there.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).orderBy("label").collect()  # a row a cluster
    names, sizes = pd.Index([r["label"] for r in facts]), np.array([r["n"] for r in facts])
    n, dim = int(sizes.sum()), max((r["dim"] for r in facts), default=0)
    slabs = max(1, -(-n * dim // SLAB_COMPONENTS))
    tasks = max(1, -(-n * -(-n // slabs) // PAIRS))
    rows = saved((there.repartition(tasks, "id") if tasks > 1 else there).select("label", "v").withColumn("row", F.monotonically_increasing_id()))
    parts = [_from_slab(rows, rows.where(F.pmod(F.xxhash64("row"), F.lit(slabs)) == i), names) for i in range(slabs)]
    sums = parts[0]
    if slabs > 1:
        sums = reduce(DataFrame.union, parts).groupBy("row").agg(F.first("c").alias("c"), V.sum_by_position("sums").alias("sums"))

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sums, own, row = np.stack(batch["sums"].to_numpy()), batch["c"].to_numpy(), np.arange(len(batch))
                own_n = sizes[own] - 1  # without the row itself, whose distance is zero
                inner = sums[row, own] / np.maximum(own_n, 1)
                means = sums / sizes
                means[row, own] = np.inf
                outer = means.min(1)
                some = (own_n > 0) & np.isfinite(outer)
                outer = np.where(some, outer, 0.0)
                yield pd.DataFrame({"s": np.where(some, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0)})

    return saved(sums.select("c", "sums").mapInPandas(scores, "s double").agg(F.avg("s").alias("silhouette")))


def _from_slab(rows: DataFrame, slab: DataFrame, names: pd.Index) -> DataFrame:
    """``(row, c, sums)``, stored: of each row the number of its cluster, and by cluster the sum of its distances from the slab's rows."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"c": [names.get_indexer(batch["label"]).astype(np.int64).tobytes()], "v": [np.stack(batch["v"].to_numpy()).tobytes()]})

    packed = slab.select("label", "v").mapInPandas(pack, "c binary, v binary").collect()  # SLAB_COMPONENTS components
    c = np.concatenate([np.frombuffer(r["c"], np.int64) for r in packed] or [np.zeros(0, np.int64)])
    x = np.concatenate([np.frombuffer(r["v"]) for r in packed] or [np.zeros(0)]).reshape(len(c), -1 if len(c) else 0)
    order = np.argsort(c, kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast((c[order], x[order]))
    del packed, c, x

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, x = shared.value
        squares = (x**2).sum(1)
        cuts = {at: np.flatnonzero(np.diff(c[at : at + WIDTH], prepend=-1)) for at in range(0, len(c), WIDTH)}
        for batch in batches:
            for start in range(0, len(batch), HEIGHT):
                part = batch.iloc[start : start + HEIGHT]
                y = np.stack(part["v"].to_numpy())
                far, square = np.zeros((len(part), len(names))), (y**2).sum(1)[:, None]
                for at, cut in cuts.items():  # where clusters begin in this part of the slab
                    away = (-2 * y) @ x[at : at + WIDTH].T
                    away += square
                    away += squares[at : at + WIDTH]
                    np.maximum(away, 0.0, out=away)
                    np.sqrt(away, out=away)
                    far[:, c[at : at + WIDTH][cut]] += np.add.reduceat(away, cut, axis=1)
                yield pd.DataFrame({"row": part["row"], "c": names.get_indexer(part["label"]), "sums": list(far)})

    found = saved(rows.mapInPandas(sums, "row long, c int, sums array<double>"))
    shared.destroy()
    return found


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, rho)`` for each pair of columns: correlation of mean ranks, by ``pyspark.ml``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df.na.drop(subset=columns))
    m = Correlation.corr(rows, "features", "spearman").first()[0].toArray()
    return df.sparkSession.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j], "a string, b string, rho double")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """``(bin, n)``: equal bins between the ends, 0 and bins + 1 for what lies outside."""
    return df.groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
