"""Samples of an exact size that are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.operators.ordered import first_k, ordinals


def order_of(id_col: str, seed: str = "42") -> Column:
    """A seeded, engine-independent order of ids."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col)))


def exact_sample(df: DataFrame, n: int, id_col: str, seed: str = "42") -> DataFrame:
    """Exactly n rows, or all if there are fewer: the first in a seeded hash order, returned by id.

    The hash of the n-th row is found by counts of its digits, and rows are filtered by it,
    so no task gathers n rows, however many columns they have. A null id counts as the
    empty text. Only where more rows of one id meet the limit are the chosen ones numbered.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col)))
    keys = {f"__key{i}": F.conv(F.substring(digest, at, size), 16, 10).cast("long") for i, (at, size) in enumerate([(1, 15), (16, 15), (31, 2)])}
    keyed = df.withColumns(keys)
    chosen = keyed.where(first_k(df.select(*(c.alias(k) for k, c in keys.items())), list(keys), n))
    if chosen.count() > n:
        chosen = ordinals(chosen, [*keys, id_col], "__ord").where(F.col("__ord") <= n)
    return chosen.select(df.columns).orderBy(id_col)


def water_fill(sizes: DataFrame, n: int, carry: bool = True) -> DataFrame:
    """``(stratum, size, quota)`` from ``(stratum, size)``: equal shares of n, small strata in full.

    From the smallest stratum on, each gets what is left divided by the strata left, or its
    size if that is less; the remainder goes to the last. Without ``carry`` every stratum
    gets the same share at most. One row per stratum is folded, in Spark.
    """
    item = F.struct("size", "stratum")
    start = F.struct(F.lit(n).cast("long").alias("left"), F.lit(0).alias("i"), F.array().cast("array<bigint>").alias("q"))

    def step(a: Column, x: Column) -> Column:
        share = F.floor(a["left"] / (F.size("all") - a["i"])) if carry else F.floor(F.lit(n) / F.size("all"))
        take = F.least(share, x["size"])
        return F.struct((a["left"] - take).alias("left"), (a["i"] + 1).alias("i"), F.concat(a["q"], F.array(take)).alias("q"))

    one = sizes.agg(F.sort_array(F.collect_list(item)).alias("all"))
    filled = one.select(F.explode(F.arrays_zip("all", F.aggregate("all", start, step, lambda a: a["q"]).alias("quota"))).alias("x"))
    return filled.select("x.all.stratum", "x.all.size", "x.quota")


def quota_sample(df: DataFrame, n: int, stratum: Column, id_col: str, seed: str = "42", excluded: tuple[str, ...] = ("other",), carry: bool = True) -> DataFrame:
    """About equal numbers from each stratum, n in all, with ``stratum`` as a column.

    Strata named in ``excluded`` and null ones are left out. If there are fewer than n rows
    all of them are taken. Ranks stop at the quota, so Spark cuts strata before the shuffle.
    """
    rows = df.withColumn("stratum", stratum).where(F.col("stratum").isNotNull() & ~F.col("stratum").isin(*excluded))
    quotas = water_fill(rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("size")), n, carry)
    rank = F.row_number().over(W.partitionBy("stratum").orderBy(order_of(id_col, seed), id_col))
    ranked = rows.withColumn("__rank", rank).where(F.col("__rank") <= n)
    return ranked.join(F.broadcast(quotas.select("stratum", "quota")), "stratum").where(F.col("__rank") <= F.col("quota")).drop("__rank", "quota")  # a row per stratum
