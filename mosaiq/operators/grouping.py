"""Greedy grouping of similar items in a given order, without walking through them one by one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators import simjoin
from mosaiq.runtime import saved, ship

THRESHOLD = 0.85
#: Items on either side of a task's comparison, and pairs of a cell that one task walks through; larger cells go in rounds.
BLOCK, WALKED = 1024, 2_000_000


def similar_pairs(items: DataFrame, id_col: str, vector: str, cell: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b)`` both ways of items whose cosine (1e-9 added to norms) reaches the threshold, with ``cell`` if it is given.

    ``cell`` names a column that only similar items share, such as a coarse index cell. A
    cell of any size is dealt out in blocks; a task multiplies two of them.
    """
    ship(items.sparkSession)
    name = F.col(cell) if cell else F.lit(0)
    rows = items.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), name.alias("cell"), F.size(vector).alias("dim"), F.col(vector).alias("v"))
    blocks = rows.groupBy("cell", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k")).select(F.col("cell").alias("c"), F.col("dim").alias("d"), "k")
    sized = rows.join(blocks, F.col("cell").eqNullSafe(F.col("c")) & (F.col("dim") == F.col("d"))).drop("c", "d")
    mine = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    dealt = sized.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def task(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["v"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + V.ADDED_EPS
        ids, side = part["id"].to_numpy(), part["mine"].to_numpy()
        left, right = np.flatnonzero(side == part["i"].iloc[0]), np.flatnonzero(side == part["j"].iloc[0])
        a, b = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = ids[left][a], ids[right][b]
        if part["i"].iloc[0] != part["j"].iloc[0]:
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
        some = a != b
        return pd.DataFrame({"cell": part["cell"].iloc[0], "a": a[some], "b": b[some]})

    kind, cells = rows.schema["id"].dataType.simpleString(), rows.schema["cell"].dataType.simpleString()
    found = dealt.select("cell", "dim", "i", "j", "mine", "id", "v").groupBy("cell", "dim", "i", "j").applyInPandas(task, f"cell {cells}, a {kind}, b {kind}")
    return found if cell else found.select("a", "b")


def heads(items: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """``(id)`` of the items that start a group: those that no earlier group's head is similar to.

    Walking items in order, the first that is in no group yet starts one with all its
    neighbours. So an item is a head exactly if none of its smaller neighbours is one.
    Pairs never leave their ``cell`` (all are in one without that column), so a task walks
    through a cell of up to ``WALKED`` pairs. Cells of more go in rounds: undecided items
    without undecided or head neighbours before them become heads, and their neighbours are
    decided. Rounds grow with the longest descending chain; each is a few joins on what is left.
    """
    ship(items.sparkSession)
    ids = items.select(F.col(id_col).alias("id"))
    before = saved((pairs if "cell" in pairs.columns else pairs.withColumn("cell", F.lit(0))).where("b < a").select("cell", "a", "b"))
    sizes = before.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select(F.col("cell").alias("c"), (F.col("n") <= WALKED).alias("small"))
    sized = before.join(sizes, F.col("cell").eqNullSafe(F.col("c"))).drop("c")
    kind = pairs.schema["a"].dataType.simpleString()

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        covered: dict = {}
        for a, b in part.sort_values(["a", "b"])[["a", "b"]].itertuples(index=False):
            covered[a] = covered.get(a, False) or not covered.get(b, False)
        return pd.DataFrame({"id": [a for a, x in covered.items() if x]})

    covered = sized.where("small").groupBy("cell").applyInPandas(walk, f"id {kind}")
    large = sized.where(~F.col("small")).select("a", "b")
    if large.isEmpty():
        return ids.join(covered, "id", "left_anti")
    large = saved(large)
    members = large.select(F.col("a").alias("id")).union(large.select(F.col("b").alias("id"))).distinct()
    return ids.join(covered, "id", "left_anti").join(members, "id", "left_anti").union(_in_rounds(ids.join(members, "id", "left_semi"), large))


def _in_rounds(undecided: DataFrame, before: DataFrame) -> DataFrame:
    """``(id)`` of the heads among ``undecided`` by pairs ``(a, b)`` with b before a."""
    undecided = saved(undecided)
    found = undecided.limit(0)
    while not undecided.isEmpty():
        waiting = before.join(undecided.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        fresh = saved(undecided.join(waiting, "id", "left_anti"))
        found = found.union(fresh)
        covered = before.join(fresh.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        undecided = saved(undecided.join(fresh, "id", "left_anti").join(covered, "id", "left_anti"))
    return found


def groups(items: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """``(head, id)``: each head with itself and all its neighbours, those of earlier groups included."""
    pairs = saved(pairs)
    h = saved(heads(items, pairs, id_col).withColumnRenamed("id", "head"))
    members = h.join(pairs.select("a", F.col("b").alias("id")), F.col("head") == F.col("a")).select("head", "id")
    return h.select("head", F.col("head").alias("id")).union(members)


def greedy_groups(items: DataFrame, id_col: str, vector: str, threshold: float = THRESHOLD, within: str | None = None) -> DataFrame:
    """``(head, id)`` as :func:`groups`, for items whose cosine reaches the threshold, by an exact join that needs no cells.

    Equal vectors are compared and walked through once: their least id decides for all, as
    whoever is near it is near its copies, which it covers itself. ``within`` names a column
    that items of a pair must share.
    """
    held = saved(simjoin.distinct_vectors(items.where(F.col(id_col).isNotNull()), id_col, vector, threshold, within))
    pairs = simjoin.threshold_pairs(items, id_col, vector, threshold, within).select("within", "a", "b")
    cell = F.col("within").alias("cell")
    both = pairs.select(cell, "a", "b").union(pairs.select(cell, F.col("b").alias("a"), F.col("a").alias("b")))
    grouped = groups(held.where("id = rep").select("rep"), both, "rep").select("head", F.col("id").alias("near"))
    return grouped.join(held.select("id", "rep"), F.col("near") == F.col("rep")).select("head", "id")


def representatives(grouped: DataFrame, items: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    """``(head, representative, size)``: the member nearest to the mean of the group's unit vectors, the first if several are."""
    unit = items.select(F.col(id_col).alias("id"), V.normalise(F.col(vector), added=True).alias("v"))
    rows = grouped.join(unit, "id")
    means = rows.groupBy("head").agg(V.mean_by_position("v").alias("m"), F.count(F.lit(1)).alias("size"))
    sim = V.dot(F.col("v"), V.normalise(F.col("m"), added=True))
    best = F.max(F.struct(F.round(sim, 12).alias("s"), (-F.col("id")).alias("i")))
    return rows.join(means, "head").groupBy("head", "size").agg(best.alias("b")).select("head", (-F.col("b.i")).alias("representative"), "size")


def aliases(grouped: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(id, representative)``: an item of several groups goes to the last of them."""
    last = grouped.groupBy("id").agg(F.max("head").alias("head"))
    return last.join(chosen.select("head", "representative"), "head").select("id", "representative")
