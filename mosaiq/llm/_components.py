"""Connected components by repeated contraction, every step a Spark job on the links that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm._common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``links`` (columns ``a`` and ``b``): the smallest node reachable.

    In each round every node moves to the least of its neighbours and itself, and links
    are carried over to where their ends went. "Least" is by the node itself in even
    rounds, which folds stars at once, and by a hash that changes in odd ones, which
    shortens chains of any order by a constant factor on average. So rounds grow with the
    logarithm of the longest chain. A hub's links are reduced before the shuffle, or are the
    long side of a join with one row a node, which Spark can split. Nothing is collected.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves = []
    while not links.isEmpty():
        n = len(moves)
        rank = (lambda c: F.struct(F.xxhash64(c, F.lit(n)).alias("h"), c.alias("x"))) if n % 2 else (lambda c: F.struct(c.alias("x")))  # noqa: B023
        ends = links.union(links.select("b", "a"))
        least = ends.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        move = written(least.select(F.col("a").alias("node"), F.least(F.col("m"), rank(F.col("a")))["x"].alias("to")))
        moves.append(move)
        ab = links.join(move.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        ab = ab.join(move.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        links = written(ab.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component"))
    at = moves[0]
    for move in moves[1:]:
        at = at.join(move.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
        at = at.select("node", F.coalesce("next", "to").alias("to"))
    at = written(at)
    smallest = at.groupBy("to").agg(F.min("node").alias("component"))
    return at.join(smallest, "to").select("node", "component")
